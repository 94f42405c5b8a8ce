"""The pipeline against the stages done by brute force, and what each stage must keep."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_tables import brute_components, brute_lines, plain_targets
from tokenizers import Tokenizer

import corpus_pipeline as P
from wattloom.llm import common as C
from wattloom.llm import mixing, packing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = C.documents(spark, SF)
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(P.STAGES)

    one = C.durable(stages["toxicity"](spark, docs, SF), "t-1")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted == 0}
    assert {r.doc_id for r in one.collect()} == clean and one.columns == docs.columns

    two = C.durable(stages["line_dedup"](spark, one, SF), "t-2")
    want = {k: text for k, _, _, text in brute_lines([(k, before[k].text) for k in clean])}
    assert {r.doc_id: r.text for r in two.collect()} == want and two.filter("n_chars <> length(text)").isEmpty()

    three = C.durable(stages["near_copies"](spark, two, SF), "t-3")
    assert {r.doc_id for r in three.collect()} == {c for _, _, c in brute_components(list(want.items()))}

    four = C.durable(stages["source_mix"](spark, three, SF), "t-4")
    size = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(mixing.words("text")).alias("n")).collect()}
    have, mixed = size(three), size(four)
    assert all(abs(mixed.get(s, 0) - n) <= 3 for s, n in plain_targets(have).items()) and four.columns == docs.columns

    five = stages["packing"](spark, four, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes() for r in four.collect()]
    assert sum(r.length for r in five) == sum(len(b) // 4 for b in ids)
    parts = {}
    for r in five:
        parts.setdefault(r.sequence_id, []).append(r)
    assert all(sum(p.length for p in ps) == ps[0].window for ps in parts.values())
    whole = {zlib.crc32(b) for b in ids}
    assert all(zlib.crc32(bytes(r.ids)) in whole for r in five if r.length == r.doc_tokens)


def test_run_is_its_stages_and_takes_nothing(spark, tmp_path):
    assert P.run(spark, SF).columns[:2] == ["doc_id", "start"] and 4 <= len(P.STAGES) <= 5
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
    assert packing.PIECE.endswith("ids binary")


def test_stages_carry_clashing_columns_and_odd_rows(spark, tmp_path):
    """Columns that operators add, or use on their way, come through every stage as they are."""
    line = "a line of forty characters or more that six documents share"
    rows = [(i, f"{line}\nown words of text {i} " + " ".join(f"v{i}x{j}" for j in range(20)), "en", "s" if i % 2 else None) for i in range(6)]
    rows += [(10, None, "en", "s"), (11, "", None, "t"), (None, "no key here", "en", "t"), (12, "w " * 30_000, "en", "t"), (13, "same text twice over", "en", "s"), (13, "same text twice over", "en", "s"), (14, " \n\t", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    names = ["size", "source_size", "target", "taken", "n_lines", "n_dropped", "score", "predicted", "toxic_spans", "component_id", "n_shingles", "key", "node", "_w_key", "_rest", "odd.name", "n"]
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")))
    spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = C.durable(docs, "t-clash")
    for name, stage in P.STAGES[:-1]:
        now = C.durable(stage(spark, now, str(tmp_path)), "t-clash")
        assert now.columns == docs.columns and now.schema == docs.schema, name
        got = now.collect()
        assert all(r[c] == (None if r.doc_id is None else f"{c}:{r.doc_id}") for r in got for c in names), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got), name
        if name in ("toxicity", "line_dedup"):
            assert len(got) == len(rows), name
        if name == "near_copies":
            assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert P.STAGES[-1][1](spark, now, str(tmp_path)).count() > 0
