"""Cases of the third review: files of many documents, neighbours in linear time, rounds of few jobs."""

import re
from hashlib import md5
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomframe.operators import boosting as bo, dedup, features
from loomframe.plans.checkpoints import scratch_path
from loomframe.plans.ordered import next_matching
from loomframe.sources import readers, sinks
from loomframe.streaming import incremental


def test_many_documents_share_a_file_and_come_back_whole(spark, tmp_path):
    odd = ["a\nb\r\nc", "", "x\x1ey", "\x1f0\x1f1\x1e\x1f", "\ufeffmark", "  end ", "\n", "\x1e", None]
    rows = [(f"c{i % 2}", odd[i] if i < len(odd) else f"text {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    sinks.write_documents(df, "lang", "text", str(tmp_path / "d"))
    assert len(list(Path(tmp_path / "d").rglob("part-*"))) <= 4
    got = readers.read_documents(spark, str(tmp_path / "d"), packed=True)
    assert sorted((r["category"], r["text"]) for r in got.collect()) == sorted((f"lang={c}", t or "") for c, t in rows)


def test_next_match_reads_no_frame_to_the_end(spark):
    """A frame up to the last row is read anew for each row: 300,000 rows in one chunk took minutes."""
    df = spark.range(0, 300_000, 1, 1).select("id", (F.col("id") % 100_000 == 99_999).alias("hit"))
    got = next_matching(df, "hit", "id", ["id"], out="near")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()
    far = got.filter(~F.col("near").eqNullSafe(F.when(F.col("id") < 299_999, ((F.col("id") + 1) / 100_000).cast("long") * 100_000 + 99_999)))
    assert far.count() == 0


def test_boosting_rounds_make_no_sql_plans(spark):
    """A round was a planned and compiled SQL query (several for trees), which took hundreds of rounds out of their limit."""
    rows = [(i, float(i * 7919 % 101), float(i * 104729 % 97), int(i * 7919 % 101 + i % 37 > 60)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    before = ran()
    assert len(bo.ada_stumps(df, ["a", "b"], "y", rounds=40).members) == 40
    assert len(bo.gradient_trees(df, ["a", "b"], "y", ["id"], rounds=25, patience=25).trees) == 25
    assert ran() - before < 30


def test_yeo_johnson_fit_repeats_no_rows(spark, monkeypatch):
    """The grid was exploded into a row per value and exponent; only the parameter table is exploded now."""
    made = []
    explode = F.explode
    monkeypatch.setattr(F, "explode", lambda c: made.append(c) or explode(c))
    df = spark.range(2000).select((F.exp(F.col("id") / 400) - 3).alias("x"), F.lit(7.0).alias("same"), F.lit(None).cast("double").alias("none"))
    lam = {r["feature"]: r["value"] for r in features.fit_yeo_johnson(df, ["x", "same", "none"]).filter("stat = 'lambda'").collect()}
    assert len(made) <= 1 and lam["same"] == lam["none"] == 1.0 and -3 <= lam["x"] <= 3 and lam["x"] != 1.0


def test_near_keys_are_compared_not_copied(spark):
    """a key of 16 digits became 20 x 56 masked copies, which all were grouped and joined back."""
    made = []
    digits = "0123456789abcdef"
    keys = ["00000000" + f"{i * 2654435761 % (1 << 32):08x}" for i in range(300)] + [digits, "f" + digits[1:], digits[:8] + "ffff" + digits[12:]]
    df = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    real = dedup.materialize

    def counted(frame):
        out = real(frame)
        made.append(out.count())
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(dedup, "materialize", counted)
        got = {r["id"]: r["source"] for r in dedup.near_sources(df, "key", "id", 16, 3).collect()}
    near = lambda a, b: sum(x != y for x, y in zip(a, b)) <= 3
    wanted = {i: [j for j in range(i) if near(keys[i], keys[j])] for i in range(len(keys))}
    assert got == {i: j[0] for i, j in wanted.items() if j} and got[301] == 300 and 302 not in got
    assert made and max(made) <= 20 * len(keys)


def test_histogram_makes_no_row_per_word(spark):
    """every word was a row that was hashed by itself, and cells were looked up in a map one by one."""
    texts = ["a b a B", "", None, "Ärger, x_1 ... a", "..", " ".join(f"w{i}" for i in range(500)), "a a"]
    keys = [1, 2, 3, 4, 5, None, 4]
    df = spark.createDataFrame(list(zip(keys, texts)), "id long, text string").repartition(3)
    got = dedup.word_histogram(df, "id", "text", 64)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    wanted = {k: [0.0] * 64 for k in keys}
    for k, text in zip(keys, texts):
        for word in re.findall(r"\w+", (text or "").lower()) if k is not None else []:
            wanted[k][int(md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
    rows = [(r["id"], r["vector"]) for r in got.collect()]
    assert len(rows) == len(keys) and all(v == wanted[k] for k, v in rows)


def test_median_bits_of_nulls_stay(spark):
    df = spark.createDataFrame([([1.0, 4.0, 3.0, 2.0],), ([None, 5.0, 1.0, 2.0],), ([None, None, None, 1.0],)], "v array<double>")
    assert [r[0] for r in df.select(dedup.median_bits("v", 4)).collect()] == ["6", "4", "0"]


def test_many_keys_take_few_calls_of_the_state_function(spark):
    """F8: each key of a micro-batch was a call with its own frames, milliseconds for a handful of rows."""
    root = scratch_path(spark, "keys")
    for lot in range(2):
        rows = [(9 * k + i, None if k == 7 else k, 100 * lot + i, None) for k in range(600) for i in range(3)]
        frame = spark.createDataFrame(rows, "id long, k long, t long, note string").withColumn("t", F.timestamp_seconds("t"))
        frame.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = incremental.file_stream(spark, f"{root}/in", frame.schema, files_per_batch=64)
        incremental.append_chunks(incremental.paired_stream(stream, ["k"], "t", ["t", "id"]), f"{root}/out", f"{root}/checkpoint")
    got = spark.read.parquet(f"{root}/out").collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r["k"], []).append((r["pair"], r["side"]))
    assert len(by_key) == 600 and all(sorted(v) == [(p, s) for p in (1, 2, 3) for s in "AB"] for v in by_key.values())
    assert spark.read.format("statestore").load(f"{root}/checkpoint").count() <= 256  # one a call
