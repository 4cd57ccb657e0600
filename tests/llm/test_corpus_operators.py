"""Resampling, quality rules and collocations against brute-force versions, on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import DOCS, frame, odd, prose

DATA = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- importance resampling -------------------------------------------------------------------------------------------


def brute_resample(rows, target):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2) for i in range(len(w) - k + 1)]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    out, able = [], []
    for i, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= 20:
                able.append((-score, i, len(out)))
        out.append([i, len(f), weight, score, None])
    able.sort()
    for rank, (_, _, at) in enumerate(able[: 25 * len(able) // 100], 1):
        out[at][4] = rank
    return out


def by_row(rows):
    return sorted((tuple(-(1 << 70) if v is None else v for v in r) for r in rows))


def test_resample_against_brute_force(spark):
    from tilewright.llm.resample import resample

    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([0, 1, 2, 19, 20, 60])).replace(" ", rng.choice([" ", "-", ". ", "\n"])).upper()) for i in range(300)]
    rows += [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    target = [prose(rng, 50), "Of the THING", None, ""]
    got = resample(frame(spark, rows).selectExpr("*", "1 as score", "2 as rank", "3 as n_words"), frame(spark, list(enumerate(target)))).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert by_row(map(tuple, got)) == by_row(brute_resample(rows, target))


@pytest.mark.parametrize("most", [1, 7, 40, 10**6])
def test_features_of_parts(monkeypatch, most):
    from tilewright.llm import resample

    monkeypatch.setattr(resample.parts, "__defaults__", (most,))
    for text in ["", "a", "one two  three-four\nFIVE six é日本 x", "x" * 90, "a b " * 30]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        for order in (1, 2, 3):
            want = Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 997 for k in range(1, order + 1) for i in range(len(w) - k + 1))
            assert Counter(b for _, own in resample.feature_buckets(text.encode(), order, 997) for b in own.tolist()) == want


def test_resample_of_no_rows_and_no_target(spark):
    from tilewright.llm.resample import resample

    none = spark.createDataFrame([], DOCS)
    assert resample(none, none).count() == 0
    rows = [(1, "a b c"), (2, None)]
    got = resample(frame(spark, rows), none).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert by_row(map(tuple, got)) == by_row(brute_resample(rows, []))


# --- quality rules ---------------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, marked = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


def test_counts_against_brute_force(monkeypatch):
    from tilewright.llm import quality_rules

    rng = random.Random(4)
    texts = [None, "", " \n", "\n\n", "a", "a\na\n a\na", "a\r\na\r\na", "é é é é é #$", "x y z x y z", "日本\n日本\n\n\n\n日本", "a b c", "z b c", "\nline", "line\n"]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "\t", "é", "#", "|", "\x0b", "🎉"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["w " * 3000]
    for most in (10, 1000, 1 << 20):
        monkeypatch.setattr(quality_rules.sliced, "__defaults__", (most,))
        counts, _ = quality_rules.measure(pa.array(texts, pa.string()))
        assert counts.tolist() == [brute_counts(t) for t in texts]


def test_features_don_t_depend_on_neighbours():
    from tilewright.llm.quality_rules import measure

    rng = random.Random(6)
    texts = ["", prose(rng, 30), None, "é日🎉", prose(rng, 5)]
    together = measure(pa.array(texts, pa.string()))[1]
    assert np.array_equal(together, np.concatenate([measure(pa.array([t], pa.string()))[1] for t in texts]))
    assert np.allclose((together[1] ** 2).sum(), 2) and not together[0].any()


def test_logistic_fit_against_gradient_descent():
    from tilewright.llm.quality_rules import _logistic

    rng = np.random.default_rng(2)
    z = rng.normal(size=(400, 5))
    label = (z[:, 0] - z[:, 1] + rng.normal(size=400) > 0.3).astype(int)
    w, x = np.zeros(6), np.concatenate((z, np.ones((400, 1))), axis=1)
    for _ in range(20000):
        w -= 0.5 * (x.T @ (1 / (1 + np.exp(-x @ w)) - label) / 400 + np.array([1e-2] * 5 + [1e-6]) * w)
    assert np.allclose(_logistic(z, label, 1e-2), w, atol=1e-3)


def test_rules_on_held_out_rows(spark):
    """Learned from two thirds of the labels: the others are told apart, and probabilities are near the shares of label 1."""
    from tilewright.llm.quality_rules import apply_rules, train

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.filter("crc32(cast(doc_id as string)) % 3 <> 0"))
    got = apply_rules(docs, model).join(labels.filter("crc32(cast(doc_id as string)) % 3 = 0"), "doc_id").select("probability", "quality").collect()
    p, q = np.array([r[0] for r in got]), np.array([r[1] for r in got])
    assert ((p >= 0.5) == q).mean() > 0.95
    assert abs(p.mean() - q.mean()) < 0.05


def test_rules_of_odd_rows(spark):
    from tilewright.llm.quality_rules import apply_rules, train

    none = spark.createDataFrame([], "doc_id long, quality int")
    model = train(odd(spark), none)
    docs = odd(spark)
    got = apply_rules(docs, model).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        want = brute_counts(texts[r["doc_id"]])
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert [r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == want and r["base_failed"] == failed and r["kept"] == (not failed)
    assert apply_rules(spark.createDataFrame([], DOCS), model).count() == 0
    with pytest.raises(ValueError, match="rename"):
        apply_rules(docs.withColumn("kept", docs["score"]), model, ["doc_id", "kept"])


# --- collocations ----------------------------------------------------------------------------------------------------


def brute_collocations(rows, fewest, top, covered=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {key: a for key, a in f.items() if a >= fewest and len(key[1]) > 1}
    inside = {(lang, p[i : i + k]) for (lang, p), a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= covered * f[lang, p[i : i + k]]}
    out = []
    for (lang, p), a in often.items():
        if (lang, p) not in inside:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            yield r[0], ranks[r[0]], *r[1:]


def texts_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").selectExpr("*", "1 as key", "2 as f", "'x' as word", "3 as rank")


@pytest.mark.parametrize("top, most_bits", [(2000, 1 << 26), (7, 1 << 26), (2000, 1 << 12)])
def test_collocations_against_brute_force(spark, monkeypatch, top, most_bits):
    from tilewright.llm import collocations as c

    monkeypatch.setattr(c, "MOST_BITS", most_bits)
    rng = random.Random(9)
    pool = "a b c of the The new york city é 日本 x-y z".split()
    rows = [(rng.choice(["en", "fr", None, "und", ""]), "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "  \t", ". ", "\n", ",", "\x0b "]) for _ in range(rng.randint(0, 60)))) for _ in range(500)]
    rows += [("en", "new york city hall " * 40), ("en", None), ("fr", ""), (None, " \n."), ("de", "only once"), ("en", "big bang theory. " * 30)]
    got = [tuple(r) for r in c.collocations(texts_frame(spark, rows), fewest=12, top=top).orderBy("lang", "rank").collect()]
    want = list(brute_collocations(rows, 12, top))
    assert got == want and len(want) > 20


def test_collocations_of_no_rows(spark):
    from tilewright.llm.collocations import collocations

    assert collocations(texts_frame(spark, [])).count() == 0
    assert collocations(texts_frame(spark, [("en", None), (None, "a b")])).count() == 0


def test_scores_past_64_bits(spark):
    from tilewright.llm.collocations import exact_score

    rng = random.Random(1)
    rows = [(a, n, a + rng.randrange(9), a + rng.randrange(10**6)) for a, n in [(100, 200), (10**13, 10**16), (99999999999999937, 99999999999999989), (7, 10**17 - 1)]]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(exact_score(*(df[c] for c in "anlr"))).collect()]
    assert got == [1000 * a * n // (left * right) for a, n, left, right in rows]


def test_collocations_against_sql(spark):
    from tilewright.llm.queries import ORACLE_SQL, op13_collocations

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    columns = "lang rank phrase a l r n score".split()
    want = db.execute(f"select {', '.join(columns)} from ({ORACLE_SQL['op13_collocations']}) order by lang, rank").fetchall()
    assert [tuple(r) for r in op13_collocations(spark, DATA).select(*columns).orderBy("lang", "rank").collect()] == want and want


# --- secrets and decontamination: chains, UTF-16, long items --------------------------------------------------------


@pytest.mark.parametrize("chain", ["%" + "25" * 100_000 + "41", "\\" + "u005cx5c" * 20_000 + "u0041", "&" + "#38;#x26;" * 20_000 + "#65;", "%u0025" + "25" * 50_000 + "u0041", "%41", "\\x41"])
def test_chains_of_escapes_are_one_layer(chain):
    from tilewright.llm.secrets import all_spans, base_spans

    text = f"a password=abcd{chain}bcdefghijkl z"
    spans, unopened = all_spans(text, base_spans(text))
    assert (2, 0, len(text) - 2) in spans and unopened == 0 and len(spans) < 5


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16-le", "utf-16-be", "utf-16"])
def test_encoded_utf16_is_read(encoding):
    import base64

    from tilewright.llm.secrets import all_spans, base_spans

    text = "run " + base64.b64encode("password=abcdefghij1234".encode(encoding)).decode() + " now"
    spans, _ = all_spans(text, base_spans(text))
    assert any(k == 0 and 4 <= s <= 8 and e > len(text) - 10 for s, k, e in spans)


def test_wide_cells_find_the_same(monkeypatch):
    from tilewright.llm import decontaminate as d

    rng = random.Random(12)
    items = [prose(rng, n) for n in (10, 30, 80)]
    docs = [prose(rng, 20) + " " + t[:40] + "x" + t[41:] + " " + prose(rng, 20) for t in items] + [prose(rng, 60)]

    def rows():
        column = pa.array(docs, pa.string())
        return d.find(d.make_block(list(enumerate(items))), *d.normalised(*d.utf8(column)))

    narrow = rows()
    monkeypatch.setattr(d, "SHORT_CELLS", 0)
    assert rows() == narrow and {(r, i) for r, i, _ in narrow} >= {(0, 0), (1, 1), (2, 2)}


# --- near-duplicates of repeated ids ---------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_ids_are_linked_by_all_their_texts(spark, seed):
    from tilewright.llm.minhash import near_duplicates

    rng = random.Random(seed)

    def near(text):
        w = text.split()
        w[rng.randrange(len(w))] = "other"
        return " ".join(w)

    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, c), (4, c), (-5, d), (6, near(d)), (6, None), (7, ""), (7, " "), (None, a), (None, None), (8, c + " and more words here")]
    got = near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {1: 1, 2: 1, 3: 1, 4: 4, -5: -5, 6: -5, 7: 7, 8: 4, None: None}
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(want.items())
    assert all(r["kept"] == (r["doc_id"] is not None and want[r["doc_id"]] == r["doc_id"]) for r in got)
    assert {r["copy_of"] for r in got if r["doc_id"] == 1} == {1} and {r["copy_of"] for r in got if r["doc_id"] == 7} == {None}
