"""The pipeline's stages on a small corpus, each against a plain version of its decision."""

import random

import numpy as np
import pytest

WORDS = "the of and thing erst onan tion ouea reth with from anin shen ndly".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(31)
    folder = tmp_path_factory.mktemp("corpus")
    items = [(k, prose(rng, 25)) for k in range(5)]
    rows, labels = [], []
    for k in range(160):
        if k % 8 == 7:
            rows.append((k, " | ".join(prose(rng, 40).upper().split()) + " !!"))
            labels.append((k, 0))
        else:
            rows.append((k, prose(rng, 60)))
            labels.append((k, 1))
    rows += [(200, rows[0][1]), (201, rows[1][1] + " end"), (202, f"{prose(rng, 30)} {items[2][1]} {prose(rng, 30)}"), (203, f"{prose(rng, 50)} password=abcdefgh12345678 {prose(rng, 10)}"), (204, None), (205, "")]
    spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, q, 0) for k, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(rows)


def test_stages(spark, corpus):
    import corpus_pipeline as P

    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.columns == P.COLUMNS
        rows = docs.collect()
        seen.append({r["doc_id"] for r in rows})
        if k < 4:
            docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if k == 3:
            safe = {r["doc_id"]: r for r in rows}
            assert "[SECRET]" in safe[203]["text"] and "abcdefgh12345678" not in safe[203]["text"] and safe[203]["n_chars"] == len(safe[203]["text"])
            assert all(r["text"] == texts[i] for i, r in safe.items() if i != 203)
    good = {k for k in range(160) if k % 8 != 7}
    assert good | {200, 201, 202, 203} <= seen[0] and not seen[0] & {k for k in range(160) if k % 8 == 7}
    assert seen[0] - seen[1] == {200, 201}
    assert seen[1] - seen[2] == {202}
    assert seen[2] == seen[3] == seen[4]
    assert all(r["ids"][-1] == 2 and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_run_gives_what_the_stages_give(spark, corpus):
    import corpus_pipeline as P

    folder, _ = corpus
    got = P.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
    ids = np.array([r["doc_id"] for r in got.select("doc_id").collect()])
    assert len(ids) == len(set(ids.tolist())) > 100
