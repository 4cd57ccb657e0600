"""Text over columns: file names, lines, URLs, colours, DICOM values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(name: Column) -> Column:
    """What follows the last dot of the last path part, or the empty text."""
    return F.regexp_extract(name, r"\.([^./\\]*)$", 1)


def base_name(name: Column) -> Column:
    return F.regexp_extract(name, r"[^/\\]*$", 0)


def with_extension(name: Column, new: str) -> Column:
    """The name with another extension (none if new is empty); one without an extension gets it appended."""
    bare = F.regexp_replace(name, r"\.[^./\\]*$", "")
    return F.concat(bare, F.lit(f".{new}")) if new else bare


def trimmed(text: Column) -> Column:
    """Without ASCII white space at either end; null stays null."""
    return F.regexp_replace(text, r"^[ \t\r\n\x0B\f]+|[ \t\r\n\x0B\f]+$", "")


def lines(text: Column) -> Column:
    """Lines between runs of carriage returns and line feeds; empty ones are dropped."""
    return F.filter(F.split(text, r"[\r\n]+"), lambda x: x != "")


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)]))


def hex_channel(colour: Column, channel: int) -> Column:
    """A channel (0 to 2) of #rrggbb; 0 if the colour isn't well-formed."""
    at = 2 + 2 * channel
    return F.when(colour.rlike("^#[0-9A-Fa-f]{6}$"), F.conv(F.substring(colour, at, 2), 16, 10).cast("int")).otherwise(0)


def host_allowed(host: Column, allowed: list[str]) -> Column:
    """Whether a host is one of the list, or ends in one of it that begins with a dot, and is longer."""
    out = F.lit(False)
    for name in allowed:
        out = out | ((host.endswith(name) & (F.length(host) > len(name))) if name.startswith(".") else (host == name))
    return out


def percent_decoded(text: Column) -> Column:
    """%XX as bytes of UTF-8; a bad escape stays as it is, and so does a plus. Bytes that aren't UTF-8 become U+FFFD."""
    safe = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(safe)


def percent_encoded(text: Column) -> Column:
    """Every byte but ASCII letters and digits as %xx in lower-case digits."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), 1)
    one = lambda h: F.when(h.rlike("^(3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])$"), F.decode(F.unhex(h), "UTF-8")).otherwise(F.concat(F.lit("%"), F.lower(h)))
    return F.array_join(F.transform(pairs, one), "")


def dicom_date(text: Column) -> Column:
    """The parts of YYYYMMDD, or null unless there are eight digits; ranges aren't checked."""
    part = lambda a, n: F.substring(text, a, n).cast("int")
    return F.when(text.rlike("^[0-9]{8}$"), F.struct(part(1, 4).alias("year"), part(5, 2).alias("month"), part(7, 2).alias("day")))


def dicom_integers(text: Column) -> Column:
    """The integers of a value with backslashes between them; a part that begins with none is null."""
    return F.transform(F.split(text, r"\\"), lambda p: F.regexp_extract(p, r"^ *([+-]?[0-9]{1,9})", 1).try_cast("int"))


def after(text: Column, separator: str) -> Column:
    """What follows the first separator, or null."""
    at = F.instr(text, separator)
    return F.when(at > 0, F.substring(text, at + len(separator), F.length(text)))


def address(url: Column) -> Column:
    """protocol, host, port and path of a URL; the port is 443 for https and 80 for others where it is left out, the path the root. Null if it has no protocol."""
    part = lambda k: F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/:?#]*)(?::([0-9]{1,5}))?(.*)$", k)
    port = F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.when(part(1) == "https", 443).otherwise(80))
    path = F.when(part(4) == "", "/").otherwise(part(4))
    return F.when(part(1) != "", F.struct(part(1).alias("protocol"), part(2).alias("host"), port.alias("port"), path.alias("path")))


def image_id(path: Column) -> Column:
    """The number of the image that a path names, by the first of the forms that fits; null if none does."""
    forms = (r"/Image/Details\?(?:.*&)?imageId=([0-9]{1,9})", "/image/([0-9]{1,9})", "/Image/([0-9]{1,9})", "/i/([0-9]{1,9})")
    return F.coalesce(*[F.nullif(F.regexp_extract(path, f, 1), F.lit("")).cast("int") for f in forms])


def local_path(uri: Column) -> Column:
    """The path of a file URI, or null for another URI."""
    path = F.regexp_replace(uri, "^file://(?:localhost)?(?:/(?=[A-Za-z]:))?", "")
    return F.when(uri.startswith("file://"), percent_decoded(path))


def crc32_of_lines(text: Column) -> Column:
    """CRC-32 without carriage returns, so that line ends of either kind count alike."""
    return F.crc32(F.replace(text, F.lit("\r"), F.lit("")))


def command_words(line: Column) -> Column:
    """Words between white space; what stands between double quotes is one word, without them."""
    return F.transform(F.regexp_extract_all(line, F.lit(r'"[^"]*"|[^\s"]+'), 0), lambda w: F.replace(w, F.lit('"'), F.lit("")))


def export_options(line: Column) -> Column:
    """Options of an export's command line as a struct, with their defaults; the file is the first word."""
    words = command_words(line)
    after_word = lambda name: F.get(words, F.array_position(words, name).cast("int"))
    value = lambda name: F.when(F.array_contains(words, name), after_word(name))
    has = lambda name: F.array_contains(words, name)
    return F.struct(
        has("--export").alias("export"), value("--roi").alias("roi"), has("--first-roi").alias("first_roi"), F.coalesce(value("--quality").try_cast("int"), F.lit(80)).alias("quality"), value("--mpp").try_cast("double").alias("mpp"),
        F.coalesce(value("--tile-size").try_cast("int"), F.lit(512)).alias("tile_size"), (~has("--no-annotations")).alias("with_annotations"), F.get(words, 0).alias("file"),
    )


def dicom_decimals(text: Column) -> Column:
    """The numbers of a decimal string with backslashes between them; a part that is none is null."""
    return F.transform(F.split(text, r"\\"), lambda p: F.nullif(F.regexp_extract(p, r"^ *([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?) *$", 1), F.lit("")).cast("double"))


def dicom_codes(text: Column) -> Column:
    """The values of a code string, without blanks at their ends."""
    return F.transform(F.split(text, r"\\"), lambda p: F.trim(p))


def dicom_time(text: Column) -> Column:
    """hour, minute, second and microsecond of HH[MM[SS[.ffffff]]]; null for what isn't there, and for all if it isn't a time."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"^([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})(?:\.([0-9]{1,6}))?)?)?$", k), F.lit(""))
    return F.struct(part(1).cast("int").alias("hour"), part(2).cast("int").alias("minute"), part(3).cast("int").alias("second"), F.rpad(part(4), 6, "0").cast("int").alias("microsecond"))


def api_call(base: str, name: Column, parameters: dict[str, Column]) -> Column:
    """The address of a call with its parameters, which are encoded; null ones are left out."""
    given = F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), percent_encoded(v)) for k, v in parameters.items()]))
    return F.concat(F.lit(base), name, F.when(F.size(given) > 0, F.concat(F.lit("?"), F.array_join(given, "&"))).otherwise(""))
