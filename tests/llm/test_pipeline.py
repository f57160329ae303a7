"""The pipeline's stages against brute force on a small corpus."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from panelloom.llm import token_codec, toxicity
from panelloom.llm.common import stored
from tests.llm.test_operators import DOCS, brute_components, prose

ITEM = "ten red foxes went over the old stone bridge before noon and no one in the village saw them come back that day"


def test_stages_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(11)
    texts = [prose(rng, int(n)) for n in rng.integers(20, 120, 150)]
    toxic = [int(i % 10 == 3) for i in range(150)]
    for i in range(150):
        if toxic[i]:
            texts[i] += " grokvile snarfool grokvile"
    for k in range(20):
        words = texts[k].split()
        words[k % len(words)] = "changed"
        texts.append(" ".join(words) if k % 2 else texts[k])
        toxic.append(toxic[k])
    texts[40] += " " + ITEM
    texts[41] = ITEM + ". " + texts[41]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "src1", 0)]
    docs = spark.createDataFrame([*rows, rows[7]], DOCS)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf_dir, kept, d = f"file://{tmp_path}", {}, docs
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mixing", "tokens"]
    for k, (name, stage) in enumerate(P.STAGES):
        d = stored(spark, stage(spark, d, sf_dir), name)
        kept[name] = d.collect()
        if k < len(P.STAGES) - 1:
            assert d.columns == P.COLUMNS
    model = toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(spark, docs, model).collect()}
    clean = {r["doc_id"] for r in kept["toxicity"]}
    assert clean == {i for i, s in scores.items() if s < P.REJECT}
    assert np.mean([(i in clean) != bool(toxic[i]) for i in range(len(texts))]) > 0.97
    want = brute_components([tuple(r) for r in kept["toxicity"]], 5, 80)
    once = [r["doc_id"] for r in kept["near_dedup"]]
    assert sorted(once) == sorted(i for i, (_, c) in want.items() if c == i)
    assert {r["doc_id"] for r in kept["decontaminate"]} == set(once) - {40, 41}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(count(r["text"]) for r in kept["mixing"]) == sum(count(r["text"]) for r in kept["decontaminate"]) // 2
    assert all(r["text"] and {x["doc_id"]: x["text"] for x in kept["decontaminate"]}[r["doc_id"]].startswith(r["text"]) for r in kept["mixing"])
    encode = token_codec.hub_encoder(token_codec.vocabulary())()
    lengths = sorted(len(b) // 4 + 1 for b in encode([r["text"] for r in kept["mixing"]]))
    assert sorted(r["n_tokens"] for r in kept["tokens"]) == lengths
    assert sorted(r["start"] for r in kept["tokens"]) == [0, *np.cumsum([r["n_tokens"] for r in sorted(kept["tokens"], key=lambda r: r["start"])])[:-1].tolist()]


def test_stages_of_empty_tables_and_odd_rows(spark, tmp_path):
    """Empty tables give empty results; rows without doc_id, with nulls, repeats and columns that clash are carried through."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    clash = ["1 as id", "2 as key", "3 as score", "4 as bucket", "5 as item_id", "6 as row", "7 as template", "8 as taken", "9 as n_tokens"]
    sf_dir = f"file://{tmp_path}"
    empty = spark.createDataFrame([], DOCS).selectExpr("*", *clash)
    for k, (_, stage) in enumerate(P.STAGES):
        got = stage(spark, empty, sf_dir)
        assert got.count() == 0 and (k == len(P.STAGES) - 1 or got.columns == P.COLUMNS)
    words = prose(np.random.default_rng(5), 4000)
    rows = [(None, words, "en", "src1", 1), (None, words, "en", "src1", 1), (1, None, None, None, None), (2, "b b b", "de", None, 5), (2, "a a a", "de", None, 5), (2, "a a a", "de", None, 5), (3, "", "en", "src1", 0), (4, words, None, "src2", None), (5, words, "en", "src9", None)]
    odd = spark.createDataFrame(rows, DOCS).selectExpr("*", *clash).repartition(3)
    ids = {}
    for k, (name, stage) in enumerate(P.STAGES[:4]):
        odd = stored(spark, stage(spark, odd, sf_dir), name)
        ids[name] = sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "")[:3]) for r in odd.collect())
    assert len(ids["toxicity"]) == 9
    assert ids["near_dedup"] == sorted([(-1, words[:3])] * 2 + [(1, ""), (2, "a a"), (3, ""), (4, words[:3])]) == ids["decontaminate"]
    assert sum(len(r["text"].split()) for r in odd.collect()) == (3 * 4000 + 3) // 2
