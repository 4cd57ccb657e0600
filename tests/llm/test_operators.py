"""Operators of the subpackage against brute-force versions, on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import json
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and thing erst onan tion ouea reth with from anin shen ndly".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", None) for r in rows], DOCS)


def odd(spark):
    rng = random.Random(3)
    long = prose(rng, 20000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, long), (5, long), (6, prose(rng, 40)), (None, prose(rng, 40)), (7, "é日本🎉 ▁ \x00x"), (8, "x" * 3000), (9, "one two three four"), (10, "one two three four")]
    return frame(spark, rows).selectExpr("*", "1 as score", "2 as n_tokens", "3 as part", "4 as h")


# --- near-duplicates -------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_all_pairs(spark):
    from tilewright.llm.minhash import near_duplicates

    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(12):
        words = prose(rng, rng.choice([3, 6, 60, 120])).split()
        for _ in range(rng.choice([1, 2, 12])):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append((n, " ".join(own).upper() if rng.random() < 0.2 else " ".join(own)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_odd_rows(spark):
    from tilewright.llm.minhash import near_duplicates

    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(odd(spark)).collect()), key=str)
    assert ("None", None, False) == (str(got[-1][0]), got[-1][1], got[-1][2])
    assert (10, 9, False) in got and (9, 9, True) in got and (1, 1, True) in got and (3, 3, True) in got
    assert [g for g in got if g[0] == 5] == [(5, 5, True)] * 2
    assert near_duplicates(frame(spark, [])).count() == 0


def test_recall_on_a_skewed_table(spark):
    """All pairs of 1,500 rows, a third of them copies of one text and a third near one another at similarities on both sides of 0.75."""
    from tilewright.llm.minhash import near_duplicates

    rng = random.Random(5)
    base, chain = prose(rng, 120).split(), prose(rng, 90).split()
    rows = [(k, " ".join(base)) for k in range(500)]
    for k in range(500, 1000):
        words = list(chain)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((k, " ".join(words)))
    rows += [(k, prose(rng, rng.randint(3, 60))) for k in range(1000, 1500)]
    rng.shuffle(rows)
    want = brute_components(rows)
    got = {r["doc_id"]: r for r in near_duplicates(frame(spark, rows).repartition(7)).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert sum(r["kept"] for r in got.values()) == len({c for _, c in want.values()}) and len({c for _, c in want.values()}) < 900


def test_components_of_a_chain(spark):
    from tilewright.llm.components import components

    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long").filter("a is not null")
    got = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# --- language --------------------------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    from tilewright.llm.language import identify, train

    rng = random.Random(7)
    alphabets = {"aa": "abcde fgh", "bb": "mnopq rst", "cc": "äöüß wvy"}
    rows = [(k, "".join(rng.choice(alphabets[x]) for _ in range(200)), x) for k, x in enumerate(sorted(alphabets) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs.filter("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in identify(docs, model).collect()}
    assert all(got[k]["lang_pred"] == x for k, _, x in rows)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    strange = identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "ЖЖЖ ШШШ " * 20)], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in strange[:3]] == ["und"] * 3 and all(r["rejected"] for r in strange)
    assert identify(odd(spark), model).count() == 12


def test_more_languages_than_one_group_holds(spark, monkeypatch):
    from tilewright.llm import language as L

    rng = random.Random(8)
    alphabets = {f"l{k:02d}": [chr(0x4E00 + 40 * k + c) for c in range(40)] + [" "] for k in range(35)}
    rows = [(k, "".join(rng.choice(alphabets[x]) for _ in range(120)), x) for k, x in enumerate(sorted(alphabets) * 5)] + [(1000, "12 !?", "l01"), (1001, None, "l02")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs)
    assert isinstance(model, L.GroupedModel) and len(model.groups) == 2 and model.langs == sorted(alphabets)
    got = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    assert len(got) == len(rows) and all(got[k]["lang_pred"] == (x if k < 1000 else "und") for k, _, x in rows)
    # groups give what one model gives
    few = docs.filter("lang < 'l06'")
    one = L.train(few)
    monkeypatch.setattr(L, "MOST_LANGUAGES", 2)
    several = L.train(few)
    assert isinstance(one, L.LanguageModel) and len(several.groups) == 3
    a, b = ({r["doc_id"]: r for r in L.identify(few, m).collect()} for m in (one, several))
    for k, r in a.items():
        assert (r["lang_pred"], r["rejected"]) == (b[k]["lang_pred"], b[k]["rejected"]) and b[k]["score"] == pytest.approx(r["score"], abs=1e-6)
        assert r["entropy"] is None and b[k]["entropy"] is None or b[k]["entropy"] == pytest.approx(r["entropy"], abs=1e-4)


def test_every_gram_of_large_alphabets_is_kept(spark):
    from tilewright.llm.language import fold, grams, letters, train

    rng = random.Random(9)
    texts = [("".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(1000)), x) for x in ("ja", "zh") for _ in range(200)]
    model = train(spark.createDataFrame(texts, "text string, lang string"), calibration_rows=0)
    own = np.unique(np.concatenate([grams(letters([t])[0]) for t, _ in texts]))
    assert len(own) > 1 << 18 and len(model.hashes[4]) == len(own)
    assert (model._find(4, fold(own, 4, model.bits)) >= 0).all()
    strange = np.setdiff1d(np.array([int.from_bytes(rng.randbytes(8), "big") for _ in range(2000)], np.uint64), own)
    assert (model._find(4, fold(strange, 4, model.bits)) < 0).all()


def test_language_probabilities_sum_to_one(spark):
    from tilewright.llm.language import train

    docs = spark.createDataFrame([("abab abba baab", "x"), ("cdc ddc cdd", "y")] * 3, "text string, lang string")
    model = train(docs)
    letters = sorted({*"abcd "})
    for context in ("   ", "aba", "zzz", " cd"):
        total = 0.0
        for c in letters:
            gram = np.array([sum(ord(x) << 16 * (3 - k) for k, x in enumerate(context + c))], np.uint64)
            total += np.exp(model.log_probabilities(gram).astype(float))
        rest = np.exp(model.log_probabilities(np.array([sum(ord(x) << 16 * (3 - k) for k, x in enumerate(context + "!"))], np.uint64)).astype(float))
        assert np.all(total + rest == pytest.approx(1.0, abs=0.02))


def brute_kneser_ney(texts):
    """Interpolated Kneser-Ney by its textbook definition: p(history, character) from plain dictionaries."""
    import unicodedata
    from collections import Counter

    framed = ["   " + re.sub(" +", " ", "".join(c.lower() if unicodedata.category(c)[0] in "LM" else " " for c in t) + " ").lstrip(" ") for t in texts]
    counts = {4: Counter(t[k - 3 : k + 1] for t in framed for k in range(3, len(t)))}
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    total, kinds = {}, {}
    for order in range(1, 5):
        total[order], kinds[order] = Counter(), Counter()
        for g, n in counts[order].items():
            total[order][g[:-1]] += n
            kinds[order][g[:-1]] += 1

    def p(gram, letters):
        if not gram:
            return 1 / (letters + 1)
        order, head = len(gram), gram[:-1]
        if not total[order][head]:
            return p(gram[1:], letters)
        return max(counts[order][gram] - 0.75, 0) / total[order][head] + 0.75 * kinds[order][head] / total[order][head] * p(gram[1:], letters)

    return p, set(counts[1])


def test_language_against_brute_force(spark):
    import unicodedata

    from tilewright.llm.language import identify, train

    rng = random.Random(51)
    forms = {"aa": "kalimanu tore", "bb": "shedrift onqua", "cc": "zorbél niçat"}
    rows = [(k, "  ".join("".join(rng.choice(forms[x]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 25))), x) for k, x in enumerate(rng.choices(list(forms), k=45))]
    unseen = [(100 + k, "".join(rng.choice("kashol qétzXY12. ") for _ in range(30)) + "e", None) for k in range(20)]
    docs = spark.createDataFrame(rows + unseen, "doc_id long, text string, lang string")
    models = {x: brute_kneser_ney([t for _, t, lang in rows if lang == x]) for x in forms}
    letters = len(set().union(*(m[1] for m in models.values())))
    got = {r["doc_id"]: r for r in identify(docs, train(docs, calibration_rows=0)).collect()}
    for i, text, _ in rows + unseen:
        framed = "   " + re.sub(" +", " ", "".join(c.lower() if unicodedata.category(c)[0] in "LM" else " " for c in text) + " ").lstrip(" ")
        entropy = {x: -sum(np.log(p(framed[k - 3 : k + 1], letters)) for k in range(3, len(framed))) / (len(framed) - 3) for x, (p, _) in models.items()}
        best = min(entropy, key=lambda x: (entropy[x], x))
        assert got[i]["entropy"] == pytest.approx(entropy[best], abs=1e-5) and got[i]["lang_pred"] == best


def test_limits_are_of_texts_left_out(spark):
    """About the stated share of new texts is rejected, and the same rows give the same model however they are dealt out."""
    from tilewright.llm.language import identify, train

    rng = random.Random(53)
    rows = [(k, " ".join(rng.choice(WORDS) + rng.choice(("", "s", "ed")) for _ in range(rng.randint(8, 40))), "en") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, new = docs.filter("doc_id < 3000"), docs.filter("doc_id >= 3000")
    model = train(seen, accepted=0.98)
    assert abs(identify(new, model).filter("rejected").count() / 3000 - 0.02) < 0.015
    again = train(seen.repartition(5), accepted=0.98)
    assert again.limit[0] == pytest.approx(model.limit[0], abs=1e-6) and again.scale == model.scale


def test_language_of_nothing(spark):
    from tilewright.llm.language import identify, train

    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(docs, train(docs)).count() == 0


# --- quality ---------------------------------------------------------------------------------------------------------


def test_quality_ranks_held_out_pairs(spark):
    from tilewright.llm.quality import score, train

    rng = random.Random(9)
    rows = [(k, prose(rng, 60) if k % 4 else " | ".join(prose(rng, 30).upper().split()) + "!!") for k in range(240)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(160)] + [(1, 1), (3, None), (None, 1), (5, 0)], "doc_id long, quality int")
    model = train(docs, labels)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in score(docs, model).collect()}
    assert all(got[k][1] == int(k % 4 > 0) for k in range(160, 240))
    assert all(p == int(s >= 0.7) for s, p in got.values())
    assert score(odd(spark).drop("score"), model).count() == 12
    with pytest.raises(ValueError):
        score(odd(spark), model, ["score"])
    assert score(frame(spark, []), train(frame(spark, []), labels.limit(0))).count() == 0


def test_ranking_against_plain_gradient_descent():
    """The weights are those at which the pairs' logistic loss is least; found by small steps here."""
    from tilewright.llm.quality import RIDGE, fit, preferences

    rng = np.random.default_rng(61)
    label = rng.integers(0, 2, 80)
    x = rng.normal(size=(80, 4)) + label[:, None] * np.array([1.0, 0.3, 0.0, -0.5])
    model = fit(x, label)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    better, worse = preferences(label)
    assert set(better) == set(np.flatnonzero(label == 1)) and set(worse) == set(np.flatnonzero(label == 0))
    w = np.zeros(4)
    for _ in range(60_000):
        step = np.zeros(4)
        diff = z[better] - z[worse]
        step = -(diff / (1 + np.exp(diff @ w))[:, None]).mean(axis=0) + RIDGE * w
        w -= 0.3 * step
        if np.abs(step).max() < 1e-7:
            break
    assert model.weights == pytest.approx(w, abs=1e-3)
    strengths = z @ w
    accepted = strengths >= model.threshold
    assert (~accepted).sum() == (label == 0).sum()
    assert ((model.scores(model.strengths(x)) >= 0.7) == accepted).all()


# --- decontamination -------------------------------------------------------------------------------------------------


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "zz"[:1]])
    return "".join(out)


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_against_full_alignment(spark):
    from tilewright.llm.decontaminate import budget, find_leaks, normalised
    from tilewright.llm.text import utf8

    rng = random.Random(11)
    items = [(k, prose(rng, rng.choice([4, 12, 30])).capitalize() + ".") for k in range(12)] + [(50, "short"), (51, None)]
    rows = []
    for k in range(60):
        text, own = prose(rng, 40), rng.choice(items[:12])[1]
        rows.append((k, f"{text}\n{edited(rng, own, rng.randint(0, 12))} {text}" if k % 2 else text))
    plain = lambda t: normalised(*utf8(pa.array([t])))[0].tobytes().strip().decode("latin-1")
    want = {}
    for k, t in rows:
        own = plain(t)
        want[k] = sorted(i for i, x in items if x and len(plain(x)) >= 20 and edit_distance_in(plain(x), own) <= budget(len(plain(x))))
    got = {r["doc_id"]: r["items"] for r in find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and sum(map(bool, want.values())) > 5


TEMPLATE = "Read the passage and answer the question with one of the words in it: "


def test_leaks_of_items_that_begin_alike(monkeypatch):
    """A hundred items of one template and four hundred documents that hold it: as full alignment says, in array steps."""
    import time

    from tilewright.llm import decontaminate as D
    from tilewright.llm.text import utf8

    rng = random.Random(15)
    items = [(k, TEMPLATE + prose(rng, 5)) for k in range(100)]
    texts = [f"{prose(rng, 20)} {TEMPLATE} {prose(rng, 20)}" for _ in range(380)] + [f"{prose(rng, 5)} {edited(rng, items[k][1], k % 14)} {prose(rng, 5)}" for k in range(20)]
    block = D.make_block(items)
    data, at = D.normalised(*utf8(pa.array(texts)))
    began = time.time()
    got = D.find(block, data, at)
    assert time.time() - began < 2
    monkeypatch.setattr(D, "MOST_HITS", 500)
    monkeypatch.setattr(D, "MOST_CELLS", 3000)
    assert sorted(D.find(block, data[: at[30]], at[:31])) == sorted(x for x in got if x[0] < 30)
    plain = lambda t: D.normalised(*utf8(pa.array([t])))[0].tobytes().strip().decode()
    own = [plain(x) for _, x in items]
    for r in (0, 7, *range(380, 400)):
        text = plain(texts[r])
        for i in range(20) if r >= 380 else (0, 50):
            edits = edit_distance_in(own[i], text)
            assert [e for a, b, e in got if (a, b) == (r, i)] == ([edits] if edits <= D.budget(len(own[i])) else [])
    assert {r for r, _, _ in got} > {380, 381, 382}


def test_leaks_of_short_items(spark):
    from tilewright.llm.decontaminate import find_leaks

    items = [(1, "what is 7 times 8"), (2, "No!"), (3, "..."), (4, "nine byte"), (None, "odd one")]
    rows = [(1, "So: What is 7 times 8? 56"), (2, "what is 7 times 80"), (3, "I know"), (4, "no"), (5, "Nine  bytes; nine-byte"), (6, "an odd one"), (7, None), (8, "no, nine byte")]
    got = {r["doc_id"]: (r["items"], r["least_edits"]) for r in find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: ([1], 0), 2: ([], None), 3: ([], None), 4: ([2], 0), 5: ([4], 0), 6: ([None], 0), 7: ([], None), 8: ([2, 4], 0)}


def test_leaks_in_several_blocks_and_odd_rows(spark, monkeypatch):
    from tilewright.llm import decontaminate

    rng = random.Random(13)
    items = [(k, prose(rng, 20)) for k in range(6)]
    rows = [(k, "Início. " + items[k % 6][1].upper().replace(" ", "  ") + " fim") for k in range(12)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    got = {r["doc_id"]: r["items"] for r in decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: [k % 6] for k in range(12)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(odd(spark), none).filter("leaked").count() == 0
    assert decontaminate.find_leaks(odd(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 12


# --- Order MinHash ---------------------------------------------------------------------------------------------------


def test_order_minhash_edits_and_neighbours(spark):
    from tilewright.llm import order_minhash as O

    rng = random.Random(15)
    rows = [(k * 3, prose(rng, rng.choice([0, 1, 3, 50, 300])) + "é🎉"[: k % 3]) for k in range(70)] + [(300, None), (-5, "")]
    got = {r["doc_id"]: r for r in O.order_minhash(frame(spark, rows), range_rows=7).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + u[:half]
        a, b, c = (O.fingerprint(O._points(x)) for x in (t, changed, u))
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (O.as_text(a), O.as_text(b))
        assert (got[i]["near_edited"], got[i]["near_next"]) == (O.likeness(a, b), O.likeness(a, c))
    assert O.order_minhash(odd(spark)).count() == 12 and O.order_minhash(frame(spark, [])).count() == 0
    assert O.order_minhash(frame(spark, [(1, "abc def")])).first()["near_next"] == 1.0


def brute_places(text):
    """The places by sorting all elements of each hash function."""
    from tilewright.llm import order_minhash as O

    points = O._points(text)
    h = np.array([sum(int(points[i + k]) * int(O._POINT[k]) for k in range(O.K)) & (1 << 64) - 1 for i in range(len(points) - O.K + 1)], np.uint64)
    kmers = (O.mix(h) >> np.uint64(32)).tolist()
    seen, elements = {}, []
    for at, k in enumerate(kmers):
        n = seen[k] = seen.get(k, -1) + 1
        e = int(O.mix(np.array([(k * 0x9E3779B97F4A7C15 + n) & (1 << 64) - 1], np.uint64))[0]) >> 32
        elements.append((e, at, k))
    out = []
    for a, b in zip(O._MULTIPLIER.tolist(), O._ADD.tolist(), strict=True):
        best = sorted((((a * e + b) & 0xFFFFFFFF), at, k) for e, at, k in elements)[: O.TUPLE]
        v = len(best)
        for _, _, k in sorted(best, key=lambda x: x[1]):
            v = int(O.mix(np.array([(v * 0x9E3779B97F4A7C15 + k) & (1 << 64) - 1], np.uint64))[0])
        out.append(v >> 32)
    return out


def test_order_minhash_places():
    from tilewright.llm import order_minhash as O

    rng = random.Random(17)
    for n in (2, 5, 40, 1500):
        text = prose(rng, n)
        assert O.fingerprint(O._points(text)).tolist() == brute_places(text)


# --- token counts, files, pieces -------------------------------------------------------------------------------------


def test_word_piece_counts(spark):
    from tilewright.llm.word_pieces import Automaton, byte_vocabulary, count_pieces

    rng = random.Random(19)
    first, more = ({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))).encode() for _ in range(12)} for _ in range(2))
    automaton = Automaton(first, more)
    words = [("".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))).encode() for _ in range(2000)]

    def greedy(w, known, other):
        i = n = 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in known), None)
            if j is None:
                return -1
            i, n, known = j, n + 1, other
        return n

    ends = np.cumsum([len(w) for w in words])
    got = automaton.lengths(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert got.tolist() == [greedy(w, first, more) for w in words]
    path = public_tokenizers.path("byte_bpe_50k.json")
    a, b = map(set, byte_vocabulary(path))
    for r in count_pieces(odd(spark).drop("n_tokens").withColumnRenamed("text", "text"), path, ["doc_id", "text"]).collect():
        own = [greedy(w.encode(), a, b) for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(own), sum(1 if n < 0 else n for n in own), own.count(-1))


def test_a_word_of_a_megabyte():
    import time

    from tilewright.llm.word_pieces import Automaton

    automaton = Automaton({b"ab", b"a", b"b", b"abba"}, {b"a", b"b", b"ba", b"bab"})
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (1 << 20, 300, 20, 20, 9, 8, 7)]
    ends = np.cumsum([len(w) for w in words])
    began = time.time()
    got = automaton.lengths(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert time.time() - began < 20
    for w, n in zip(words, got.tolist(), strict=True):
        known, i, count = {b"ab", b"a", b"b", b"abba"}, 0, 0
        while i < len(w):
            i += next(k for k in (4, 3, 2, 1) if w[i : i + k] in known and len(w[i : i + k]) == k)
            known, count = {b"a", b"b", b"ba", b"bab"}, count + 1
        assert n == count


def test_word_pieces_of_other_scripts(spark):
    """The longest match over the whole vocabulary, of each word with the space before it."""
    from tilewright.llm.word_pieces import count_pieces

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    pieces = {bytes(spelt[c] for c in t) for t in vocab if all(c in spelt for c in t)}

    def greedy(w):
        i = n = 0
        while i < len(w):
            i, n = next(j for j in range(len(w), i, -1) if w[i:j] in pieces), n + 1
        return n

    rng = random.Random(20)
    alphabet = "中文字日本語ひらがな한국어हिन्दीไทยабвгруфхя🎉éñ’\x00\x01\x7fabthe.1"
    texts = ["中文没有空格的段落很长很长", "日本語 한국어 हिन्दी ไทย русский 🎉🎉", "\x00x plain"] + [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(40)]
    for r in count_pieces(frame(spark, enumerate(texts)), path, ["text"], lone_space=True).collect():
        own = [greedy(b" " + w.encode()) for w in r["text"].split(" ")]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(own), sum(own), 0), r["text"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab cde'stl  \n\t  　éñ’12,.!|日🎉\x85")), max_size=60), min_size=1, max_size=4))
def test_token_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    from tilewright.llm.token_files import encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = [ids[at[k] : at[k + 1]].tolist() for i, j, ids, at in encoder(path).encode(pa.array(texts), 0) for k in range(j - i)]
    assert got == [[*e.ids, 0] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    from tilewright.llm.token_files import read_tokens, token_digest, write_tokens

    path, library = str(tmp_path / "tokens"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(21)
    rows = [(k, prose(rng, rng.randint(0, 30))) for k in rng.sample(range(-50, 200), 90)] + [(500, None)]
    write_tokens(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), path, file_rows=20)
    start, want = 0, []
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_digest(spark, path).collect())) == want
    assert read_tokens(spark, path, [rows[0][0]]).count() == 1
    write_tokens(odd(spark), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "odd"))
    assert token_digest(spark, str(tmp_path / "odd")).count() == 12
    # rows of one id, some of them equal: every slice that the digest names is what stands there in the files, end to end
    again = frame(spark, [(1, prose(rng, 11)), (1, "two"), (1, None), (1, "two"), (2, "three"), (None, "four"), (2, prose(rng, 400)), *((3, prose(rng, k)) for k in range(60))])
    write_tokens(again, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "again"), file_rows=4)
    rows = read_tokens(spark, str(tmp_path / "again")).orderBy("part", "place").collect()
    flat, starts = [x for r in rows for x in r["ids"]], {}
    assert len({r["part"] for r in rows}) > 8 and [r["doc_id"] or 0 for r in rows] == sorted(r["doc_id"] or 0 for r in rows)
    digest = token_digest(spark, str(tmp_path / "again")).collect()
    assert sorted((r["start"], r["n_tokens"]) for r in digest) == [(sum(len(x["ids"]) for x in rows[:k]), len(rows[k]["ids"])) for k in range(len(rows))]
    assert all(zlib.crc32(np.array(flat[r["start"] : r["start"] + r["n_tokens"]], "<u4").tobytes()) == r["ids_crc32"] for r in digest)
    write_tokens(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "none"))
    assert token_digest(spark, str(tmp_path / "none")).count() == 0


def scanned(df):
    """The rows that a query's scan brought in, after the files' indexes were used."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_token_files_are_pruned(spark, tmp_path):
    from tilewright.llm.token_files import read_tokens, write_tokens

    docs = spark.range(0, 20000, 2).selectExpr("id as doc_id", "'some words' as text")
    for bloom in (False, True):
        write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / f"t{bloom}"), file_rows=5000, bloom=bloom)
    read = {bloom: read_tokens(spark, str(tmp_path / f"t{bloom}"), [7001]) for bloom in (False, True)}
    # the id is between two others: statistics leave one row group of one file, Bloom filters none
    assert (scanned(read[False]), scanned(read[True])) == (1024, 0)
    assert read[True].count() == 0 and scanned(read_tokens(spark, str(tmp_path / "tTrue"), [7000])) == 1024
    assert read_tokens(spark, str(tmp_path / "tTrue"), [7000]).first()["n_tokens"] == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcdetheingrou   ▁\n\t日🎉é1.,\x00")), max_size=80), min_size=1, max_size=4))
def test_piece_ids_are_the_librarys(texts):
    from tilewright.llm.piece_bpe import loaded

    model, store = loaded(public_tokenizers.path("piece_bpe_32k.model"))
    got = [ids[at[k] : at[k + 1]].tolist() for i, j, ids, at in model.encode(pa.array(texts), store) for k in range(j - i)]
    assert got == model.library.encode(texts, add_eos=True)


def test_long_pieces_and_small_stores(monkeypatch):
    from tilewright.llm import segments
    from tilewright.llm.piece_bpe import PieceModel, SegmentStore

    model = PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(23)
    texts = ["".join(rng.choice("abcdethiou") for _ in range(n)) for n in (399, 400, 401, 3000)] + ["a" * 999, prose(rng, 300)]
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 40)
    store = SegmentStore()
    for _ in range(2):
        got = [ids[at[k] : at[k + 1]].tolist() for i, j, ids, at in model.encode(pa.array(texts), store) for k in range(j - i)]
        assert got == model.library.encode(texts, add_eos=True)


def test_rounds_are_the_librarys_on_any_run():
    """Long runs of pieces and letters, whose merges may hinder one another, and a word of a megabyte."""
    from tilewright.llm.piece_bpe import MARK, loaded

    model, _ = loaded(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(29)
    early = [p for p, s in model.symbol.items() if s < len(model.names) and model.early[s] and MARK not in p]
    assert len(early) > 1000
    for alphabet in (early, rng.sample(early, 40), list("aeinst"), list("ab"), ["e", "es", "s", "st"], list("日本語中国人")):
        for n in (2, 7, 60, 900):
            texts = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(20)]
            ids, size = model.encode_segments([MARK + t for t in texts])
            at = np.concatenate(([0], np.cumsum(size)))
            assert [ids[at[k] : at[k + 1]].tolist() for k in range(20)] == model.library.encode(texts)
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    assert model.encode_segments([MARK + long])[0].tolist() == model.library.encode(long)


def test_spans_that_share_a_hash():
    """Thue-Morse words and their opposites collide under any polynomial hash of 64 bits; the second hash tells them apart."""
    from tilewright.llm.segments import SegmentStore
    from tilewright.llm.text import BYTE_HASH, span_check, span_hash

    word = b"a"
    for _ in range(12):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(word + word.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    spans = np.array([0, len(word)]), np.array([len(word), 2 * len(word)])
    h, check = span_hash(BYTE_HASH[data], *spans), span_check(BYTE_HASH[data], *spans)
    assert h[0] == h[1] and check[0] != check[1]
    store = SegmentStore()
    encode = lambda k: (k.astype(np.int32), np.ones(len(k), np.int64))
    assert store.lookup(h, check, encode)[0].tolist() == [0, 1]
    assert store.lookup(h[:1], check[:1], encode)[0].tolist() == [0] and store.lookup(h[1:], check[1:], lambda k: (k.astype(np.int32) + 7, np.ones(1, np.int64)))[0].tolist() == [7]


def test_encode_decode_rows(spark):
    from tilewright.llm.piece_bpe import encode_decode, loaded

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = loaded(path)[0].library
    for r in encode_decode(odd(spark), path, ["doc_id", "text"], with_ids=True).collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    with pytest.raises(ValueError):
        encode_decode(odd(spark), path, ["n_tokens"])


# --- secrets ---------------------------------------------------------------------------------------------------------


def test_secret_layers():
    from urllib.parse import quote

    from tilewright.llm.secrets import all_spans, base_spans, joined, redacted

    plain = "password=abcdefghij1234"
    once = base64.b64encode(f"note: {plain} end".encode()).decode()
    cases = {
        plain: f"assign:0:{len(plain)}",
        f"x {once} y": None,
        "x " + base64.b64encode(once.encode()).decode(): None,
        "x " + base64.b64encode(zlib.compress(f"{plain} {plain}".encode())).decode(): None,
        "q?" + quote(f"a {plain}", safe="").replace("=", "%3D"): None,
        "".join(f"\\u{ord(c):04x}" for c in plain): f"assign:0:{6 * len(plain)}",
        "AKIA" + "A" * 14 + " AKIA" + "B" * 13: "access:0:18",
        "token=short secret: 'abcdefghijkl": f"assign:12:{12 + len("secret: 'abcdefghijkl")}",
        "0123456789abcdef 0123456789abcde": "hex:0:16",
        "plain text, 100% of it \\u12": "",
    }
    for text, want in cases.items():
        spans, _ = all_spans(text, base_spans(text))
        if want is None:
            assert any(k == 0 for _, k, _ in spans), text
        else:
            assert joined(spans) == want, text
        assert all(0 <= s < e <= len(text) for s, _, e in spans)
    assert redacted(plain + " ok", base_spans(plain)) == "[SECRET] ok"


def test_secret_layers_of_every_writing(spark, monkeypatch):
    import gzip
    import textwrap

    from tilewright.llm import secrets as S

    plain = "password=abcdefghij1234"
    note = f"some words before {plain} and many words after it"
    b64 = lambda raw: base64.b64encode(raw).decode()
    url = lambda raw: base64.urlsafe_b64encode(raw).decode()
    noise = random.Random(1).randbytes(3000)
    asked = f" ask? who>> me? ok~~ {plain} end".encode()
    assert set(url(asked)) & set("-_")
    whole = [url(asked), b64(asked).rstrip("="), "key-" + b64(note.encode()), "a/bc" + b64(note.encode()), "x" + b64(note.encode()), "payload\n" + b64(note.encode())]
    whole += [b64(zlib.compress(note.encode(), k)) for k in range(10)] + [url(zlib.compress(note.encode() + noise, k)) for k in (2, 6)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 10)
    whole += [b64(packer.compress(note.encode()) + packer.flush()), b64(gzip.compress(b"first member") + gzip.compress(note.encode())), b64(zlib.compress(note.encode()) + b"trailing")]
    for size in (10, 16, 64, 76):
        whole += [gap.join(textwrap.wrap(b64(raw), size)) for gap in ("\n", "\r\n", "\n    ") for raw in (note.encode(), zlib.compress(note.encode()), zlib.compress(note.encode() + noise))]
    whole += [b64(b"\x00\x01\xff" + note.encode() + b"\xfe\x00"), b64(b64(zlib.compress(note.encode(), 3)).encode()), "%ff" + "".join(f"%{c:02x}" for c in plain.encode()), "\\ud800" + "".join(f"\\x{ord(c):02x}" for c in plain)]
    for run in whole:
        text = f"see {run} there"
        spans, unopened = S.all_spans(text, [])
        assert any(k == 0 for _, k, _ in spans) and all(4 <= s < e <= 4 + len(run) for s, _, e in spans) and not unopened, run
    cut = b64(zlib.compress(note.encode() + noise)[:-500])
    broken = bytearray(zlib.compress(note.encode() + noise, 0))
    broken[-2] ^= 255
    for run in (cut, b64(bytes(broken))):
        spans, unopened = S.all_spans(f"see {run} there", [])
        assert any(k == 0 for _, k, _ in spans) and unopened == 1
    monkeypatch.setattr(S, "MOST_UNPACKED", 1 << 12)
    monkeypatch.setattr(S, "PIECE", 1 << 11)
    monkeypatch.setattr(S, "OVERLAP", 1 << 8)
    for before in (10, 2040, 2050, 9000, 300000):
        text = b64(zlib.compress(b"x " * (before // 2) + note.encode() + b" y" * 5000))
        assert S.all_spans(text, []) == ([(0, 0, len(text))], 1)
    rows = {r["doc_id"]: r for r in S.scan_secrets(frame(spark, [(k, f"see {run} there") for k, run in enumerate(whole)]), redact=True).collect()}
    assert all(rows[k]["redacted"].startswith("see ") and "[SECRET]" in rows[k]["redacted"] and rows[k]["n_spans"] for k in range(len(whole)))


def deflated(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


def test_secrets_in_random_nestings():
    """Whatever layers a secret is put into, and whatever stands beside it in each, it is found inside the outermost run; a brute-force unwrapper undoes the same layers."""
    import bz2
    import gzip
    import lzma

    from tilewright.llm.secrets import all_spans, base_spans

    b64 = lambda data: base64.b64encode(data).decode()
    unpack = [(gzip.compress, gzip.decompress), (deflated, lambda d: zlib.decompress(d, -15)), (bz2.compress, bz2.decompress), (lzma.compress, lzma.decompress)]
    unpack += [((lambda d, n=n: zlib.compress(d, n)), zlib.decompress) for n in range(10)]
    layers = [
        (lambda t: "".join(f"%{b:02X}" for b in t.encode()), lambda t: bytes.fromhex(t.replace("%", "")).decode()),
        (lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: "".join(chr(int(x, 16)) for x in t.split("\\u")[1:])),
        (lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t), lambda t: "".join(chr(int(x[1:-1], 16)) for x in t.split("\\u")[1:])),
        (lambda t: "".join(f"&#{ord(c)};" for c in t), lambda t: "".join(chr(int(x)) for x in t.replace("&#", "").split(";")[:-1])),
        (lambda t: "".join(f"\\x{ord(c):02x}" for c in t), lambda t: "".join(chr(int(x, 16)) for x in t.split("\\x")[1:])),
        (lambda t: b64(t.encode()), lambda t: base64.b64decode(t).decode()),
        (lambda t: base64.urlsafe_b64encode(t.encode()).decode(), lambda t: base64.urlsafe_b64decode(t).decode()),
        (lambda t: base64.encodebytes(t.encode()).decode().rstrip("\n"), lambda t: base64.decodebytes(t.encode()).decode()),
        (lambda t: b64(b"\xff\x00\xfe" + t.encode() + b"\x00\xff"), lambda t: base64.b64decode(t)[3:-2].decode()),
        *((lambda t, f=f: b64(f(t.encode())), lambda t, g=g: g(base64.b64decode(t)).decode()) for f, g in unpack),
    ]
    rng = random.Random(41)
    secret = "password=abcdefghij1234"
    for _ in range(400):
        steps = [rng.choice(layers) for _ in range(rng.randint(1, 4))]
        inner, runs = secret, []
        for wrap, _ in steps:
            left, right = rng.choice(["", "see ", "x: ", "no\u00a0break "]), rng.choice(["", " end", ". more", "\n"])
            left, right = (left, right) if inner == secret or runs else ("", "")
            if any(ord(c) > 255 for c in inner):
                break
            runs.append((len(left), inner))
            inner = wrap(left + inner + right)
            runs[-1] = (left, right, inner)
        before, after = rng.choice(["", "Look at ", "path/", "key "]), rng.choice(["", " and so on", ".", ", then"])
        text = before + inner + after
        found, _ = all_spans(text, base_spans(text))
        assert any(k == 0 and len(before) <= s < len(before) + len(inner) and e <= len(before) + len(inner) + (after == ".") for s, k, e in found), text
        for (left, right, run), (_, undo) in zip(reversed(runs), reversed(steps[: len(runs)]), strict=True):
            assert inner == run
            inner = undo(run)
            inner = inner[len(left) : len(inner) - len(right)]
        assert inner == secret


def test_secret_rows_against_plain_patterns(spark):
    from tilewright.llm.secrets import scan_secrets

    rng = random.Random(25)
    bits = ["password = ", "Api_Key: '", "AKIA", "0123456789abcdef", "Q7" * 9, " ", "\n", "é🎉", "token", "==", "deadbeef" * 3, '"', ":"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for k in range(300)] + [(1000, None)]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in scan_secrets(frame(spark, rows), ["doc_id", "text"], redact=True).collect():
        t = r["text"] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert (r["redacted"] is None) == (r["text"] is None)
    assert scan_secrets(odd(spark)).count() == 12 and scan_secrets(frame(spark, [])).count() == 0


# --- tool calls ------------------------------------------------------------------------------------------------------


def test_tool_calls(spark):
    from tilewright.llm.tool_calls import link_calls

    calls = [(1, "a", 0, "f", '{"b": 1, "a": [2, 1]}'), (1, "b", 2, "f", '{"b": "x"}'), (1, "c", 4, "g", "{}"), (1, "d", 6, "f", "{nope"), (2, "a", 0, "f", None), (2, "x", 1, "f", '{"b":2,"é":null}'), (2, "y", 2, "f", '{"b":3}'), (1, "a", 0, "f", '{"b": 1, "a": [2, 1]}'), (None, "a", 0, "f", "{}")]
    results = [(1, "a", 1), (1, "a", 9), (1, "zz", 3), (2, "x", None), (None, "a", 1)]
    needs = [(1, "b", "a"), (1, "c", "a"), (1, "c", "b"), (1, "d", "missing"), (2, "x", "y"), (2, "y", "x"), (2, "a", None)]
    schemas = {"f": {"type": "object", "required": ["b"], "properties": {"b": {"type": "integer"}}}}
    df = link_calls(spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string"), spark.createDataFrame(results, "conv_id long, call_id string, turn long"), spark.createDataFrame(needs, "conv_id long, call_id string, needs string"), schemas)
    got = {(r["conv_id"], r["call_id"]): r for r in df.collect()}
    assert {k: r["level"] for k, r in got.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (2, "a"): 0, (2, "x"): None, (2, "y"): None}
    assert got[1, "a"]["arguments"] == '{"a":[2,1],"b":1}' and got[1, "a"]["valid"] and got[1, "a"]["n_results"] == 2 and got[1, "a"]["result_turn"] == 1
    assert got[1, "b"]["problems"] == "$.b: not integer" and got[1, "c"]["problems"] == "unknown tool" and got[1, "d"]["problems"] == "not JSON" and got[1, "d"]["arguments"] is None
    assert got[2, "x"]["arguments"] == '{"b":2,"é":null}' and got[2, "x"]["linked"] and not got[2, "y"]["linked"]
    assert json.loads(got[2, "x"]["arguments"]) == {"b": 2, "é": None}


def test_levels_of_random_graphs(spark):
    from tilewright.llm.tool_calls import levels

    rng = random.Random(27)
    needs = {k: rng.sample(range(k), min(k, rng.choice([0, 1, 1, 1, 1, 2, 3]))) for k in range(60)}
    needs |= {100 + k: [100 + k - 1] if k else [] for k in range(70)} | {200: [201], 201: [202], 202: [200], 203: [200, 5], 204: [203]}
    want = {}
    for k in sorted(needs):
        want[k] = None if k >= 200 else max([want[n] + 1 for n in needs[k]], default=0)
    calls = spark.createDataFrame([(1, str(k)) for k in needs], "conv_id long, call_id string")
    edges = spark.createDataFrame([(1, str(k), str(n)) for k, own in needs.items() for n in own], "conv_id long, call_id string, needs string")
    got = levels(calls, edges).collect()
    assert {int(r["call_id"]): r["level"] for r in got} == want
    place = lambda k: (want[k] is None, want[k] or 0, str(k))
    assert [int(r["call_id"]) for r in sorted(got, key=lambda r: r["position"])] == sorted(needs, key=place)
    # the same by all tasks in rounds, with turns and a short conversation beside
    more = calls.selectExpr("conv_id", "call_id", "cast(call_id as long) * 777 % 20000 as turn").union(spark.createDataFrame([(2, "1", 0), (2, "1", 5), (2, "2", None)], "conv_id long, call_id string, turn long"))
    one = {(r["conv_id"], r["call_id"]): (r["level"], r["position"]) for r in levels(more, edges).collect()}
    assert {(r["conv_id"], r["call_id"]): (r["level"], r["position"]) for r in levels(more, edges, most_rows=50).collect()} == one and len(one) == len(needs) + 2


def test_arguments_of_every_kind():
    from tilewright.llm.tool_calls import canonical, checked, parsed

    f = {"f": {"properties": {"b": {"type": "integer"}, "c": {"enum": [1, "x"]}, "d": {"const": 2.5}, "e": {"pattern": "^a+$"}}}}
    assert checked("f", '{"b":"\\ud800"}', f) == (None, "lone surrogate")
    assert checked("f", '{"b":' + "9" * 400 + "}", f)[1] == "" and checked("f", '{"b":' + "9" * 5000 + ".5}", f)[1] == "$.b: not integer"
    assert checked("f", '{"b":1e400}', f) == ('{"b":1e+400}', "") and checked("f", '{"b":NaN}', f)[1] == "not JSON"
    assert checked("f", "[" * 100_000, f)[1] == "nested too deeply" and checked("f", None, f)[1] == "not JSON"
    assert checked("f", '{"b":1e99999999999999999999}', f)[1] == "number out of range"
    assert checked("f", '{"c":true}', f)[1] == "$.c: not in enum" and checked("f", '{"c":1.0,"d":2.50,"e":"aa"}', f) == ('{"c":1,"d":2.5,"e":"aa"}', "")
    assert checked("f", '{"d":2,"e":"b"}', f)[1] == "$.d: not the constant; $.e: pattern"
    same = [["1", "1.0", "1e0", "10e-1", "0.1e1"], ["-0", "0.0", "0e5"], ["1e21", "1" + "0" * 21], ["0.0000001", "1e-7"], ["123.4500", "12345e-2"], ["1e20", "1" + "0" * 20]]
    assert [{canonical(parsed(x)) for x in own} for own in same] == [{"1"}, {"0"}, {"1e+21"}, {"1e-7"}, {"123.45"}, {"1" + "0" * 20}]


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"])), x), max_leaves=8))
def test_canonical_json_is_the_value_again(value):
    from tilewright.llm.tool_calls import canonical, parsed

    text = canonical(value)
    again = parsed(json.dumps(value))
    assert parsed(text) == again and canonical(again) == text


def test_tool_calls_of_odd_rows(spark):
    from tilewright.llm.tool_calls import link_calls, unlinked_results

    shape = "conv_id long, call_id string, turn long, name string, arguments string, level int, first string"
    long = json.dumps({"b": 1, "t": "x" * 200_000})
    calls = spark.createDataFrame([(1, "a", None, None, None, 9, "z"), (1, "b", 3, "f", long, 9, "z"), (1, "b", 3, "f", long, 9, "z"), (None, None, 1, "f", "{}", 9, "z")], shape)
    results = spark.createDataFrame([(1, "b", 5, "two"), (1, "b", 4, "one"), (1, "b", 4, "one"), (1, "b", 4, None), (1, "zz", 1, "lost"), (None, "b", 0, "x"), (1, "a", None, None)], "conv_id long, call_id string, turn long, content string")
    needs = spark.createDataFrame([(1, "a", "b"), (None, "a", "b")], "conv_id long, call_id string, needs string")
    got = {r["call_id"]: r for r in link_calls(calls, results, needs, {"f": {}}).collect()}
    assert got["b"]["call_message"] == json.dumps({"role": "assistant", "tool_calls": [{"function": {"arguments": json.dumps(json.loads(long), separators=(",", ":")), "name": "f"}, "id": "b", "type": "function"}]}, separators=(",", ":"))
    assert got["b"]["result_message"] == '{"content":"one","role":"tool","tool_call_id":"b"}' and (got["b"]["result_turn"], got["b"]["n_results"], got["b"]["position"]) == (4, 4, 0)
    assert got["a"]["call_message"] is None and got["a"]["result_message"] == '{"content":null,"role":"tool","tool_call_id":"a"}' and (got["a"]["level"], got["a"]["position"]) == (1, 1)
    rest = sorted(((r["call_id"], r["turn"], r["content"], r["status"], r["copies"]) for r in unlinked_results(calls, results).collect()), key=str)
    assert rest == [("b", 4, "one", "further result", 1), ("b", 4, None, "further result", 1), ("b", 5, "two", "further result", 1), ("zz", 1, "lost", "no call", 1)]
    none = [df.limit(0) for df in (calls, results, needs)]
    assert link_calls(*none, {}).count() == 0 and link_calls(calls, none[1], none[2], {}).filter("linked").count() == 0
