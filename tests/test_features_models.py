"""Feature, text, image, de-duplication and model behaviour on small hand-made inputs."""

import math
import random
import struct
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import scalar, text as tx
from loomframe.operators import clean, dedup, features as ft, images, lookup, metrics as mx, models as md, similarity as sim, web, window
from loomframe.operators import text as txt
from loomframe.plans.checkpoints import scratch_path
from loomframe.sources import readers

CREW = [
    ("Ann", "Director", "Directing"), ("Bo", "Producer", "Production"), ("Cy", "Writer", "Writing"), ("Di", "Producer", "Writing"),
    ("Ed", "Director", "Directing"), ("Flo", "Author", "Writing"), ("Gus", "Story", "Writing"), ("Hal", "Producer", "Production"),
]


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_pick_crew(spark):
    df = spark.createDataFrame([(CREW,)], "crew " + readers.NAME_ROLE)
    row = df.select(*[c.alias(n) for n, c in clean.pick_crew(F.col("crew")).items()]).first()
    assert (row["director"], row["producer"], row["writers"]) == ("ed", "hal", ["cy", "di", "flo"])


def test_bins_are_right_closed(spark):
    edges, labels = [-1, 0, 5, 12], ["none", "infant", "child"]
    df = spark.createDataFrame([(v,) for v in (-1.0, -0.5, 0.0, 5.0, 5.1, 12.0, 12.1)], "x double")
    got = [r["b"] for r in df.select("x", ft.cut(F.col("x"), edges, labels).alias("b")).orderBy("x").collect()]
    assert got == [None, "none", "none", "infant", "child", "child", None]


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    for kind in ft.SCALERS:
        assert {r["x"] for r in ft.scale(df, ft.fit_scaler(df, ["x"], kind)).collect()} == {0.0}


def test_standard_scale_has_mean_zero_and_std_one(tables):
    df = tables.lineitem.select("l_quantity")
    row = ft.scale(df, ft.fit_scaler(df, ["l_quantity"], "standard")).agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s")).first()
    assert abs(row["m"]) < 1e-9 and row["s"] == pytest.approx(1.0)


def test_yeo_johnson_finds_the_likelihood_peak(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400) ** 2 * 3 - 0.5

    def loglike(lam):
        y = np.where(x >= 0, ((x + 1) ** lam - 1) / lam if lam else np.log1p(x), -((1 - x) ** (2 - lam) - 1) / (2 - lam) if lam != 2 else -np.log1p(-x))
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))

    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    params = {r["stat"]: r["value"] for r in ft.fit_yeo_johnson(df, ["x"]).collect()}
    best = max(np.arange(-2, 3, 0.001), key=loglike)
    assert params["lambda"] == pytest.approx(best, abs=2e-3)
    assert ft.apply_yeo_johnson(df, ft.fit_yeo_johnson(df, ["x"])).agg(F.stddev_pop("x")).first()[0] == pytest.approx(1.0)


def test_clean_document(spark):
    text = F.lit("XXXXHello, the WORLD! It costs 42 euros — ça   va.")
    assert one(spark, tx.clean_document(text, ["the", "it"])) == "hello world costs euros ça va"


def test_tf_idf_by_hand(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue sky"), (3, "red")], "id int, text string")
    counts = txt.term_counts(docs, "id", "text")
    vocabulary = txt.fit_vocabulary(counts, 3, 2)
    got = {(r["id"], r["term"]): r["weight"] for r in txt.tf_idf(counts, vocabulary, "id").collect()}
    idf = math.log(4 / 3) + 1
    assert set(got) == {(1, "red"), (1, "blue"), (2, "blue"), (3, "red")}
    assert got[(1, "red")] == pytest.approx(2 * idf / math.hypot(2 * idf, idf)) and got[(2, "blue")] == pytest.approx(1.0)


def test_label_bag_splits_on_comma_and_blanks(spark):
    df = spark.createDataFrame([(1, "Drama, Comedy"), (2, "Comedy,Horror"), (3, "Drama")], "id int, genre string")
    dictionary = txt.label_codes(df, "id", "genre")
    assert {r["label"]: r["code"] for r in dictionary.collect()} == {"Drama": 1, "Comedy": 2, "Horror": 3}
    bag = txt.code_bag(df, "id", "genre", dictionary, 2)
    assert {r["id"]: (r["code_1"], r["code_2"]) for r in bag.collect()} == {1: (1, 2), 2: (2, 3), 3: (1, 0)}


def test_last_matching_band_wins(spark):
    bands = [("a", [(0, 10)]), ("b", [(5, 15)])]
    name = lambda v: one(spark, lookup.band_names([F.lit(v)], bands))
    assert (name(3), name(7), name(20)) == ("a", "b", "[?]")


def test_local_maxima_and_compat(spark):
    df = spark.createDataFrame(list(enumerate([1, 5, 2, 7, 3, 9, 1])), "pos int, y int").withColumn("s", F.lit(0))
    peaks = lambda compat: [r["index"] for r in window.local_maxima(df, ["s"], "pos", "y", compat).orderBy("index").collect()]
    assert peaks(False) == [1, 3, 5]
    assert peaks(True) == [2, 4]


def test_numeric_and_names(spark):
    df = spark.createDataFrame([("12",), ("1.5",), ("1.2.3",), (".",), ("a1",), ("",)], "s string")
    assert [r["n"] for r in df.select(scalar.is_numeric("s").alias("n")).collect()] == [True, True, False, False, False, False]
    assert one(spark, scalar.name_number(F.lit("sample-12-1"))) == 12
    assert one(spark, scalar.file_extension(F.lit("http://a.com/x/pic.jpg?b=.gif"))) == "jpg"


def brute_sources(keys, limit):
    near = lambda a, b: sum(x != y for x, y in zip(a, b)) <= limit
    out = {}
    for i, j in combinations(range(len(keys)), 2):
        if j not in out and near(keys[i], keys[j]):
            out[j] = i
    return out


def mutated_keys(digits, families, copies, limit, seed):
    rng = random.Random(seed)
    keys = set()
    for _ in range(families):
        base = [rng.choice("0123456789abcdef") for _ in range(digits)]
        for _ in range(copies):
            copy = list(base)
            for i in rng.sample(range(digits), rng.randint(0, limit + 2)):
                copy[i] = rng.choice("0123456789abcdef")
            keys.add("".join(copy))
    return sorted(keys, key=lambda k: hash((seed, k[::-1])))


@pytest.mark.parametrize("digits,limit,block,work", [(16, 3, 128, 10**6), (16, 1, 128, 10**6), (64, 10, 128, 10**6), (64, 10, 4, 400), (12, 8, 2, 10), (8, 6, 2, 10)])
def test_near_sources_match_brute_force(spark, digits, limit, block, work):
    """Includes a shared prefix (a hot bucket) and, with little work allowed, several splits of a bucket."""
    keys = mutated_keys(digits, 6, 10, limit, digits + limit)
    hot = ["0" * (digits // 2) + k[digits // 2 :] for k in keys[:25]]
    keys = list(dict.fromkeys(keys + hot))
    df = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    got = {r["id"]: r["source"] for r in dedup.near_sources(df, "key", "id", digits, limit, block, work).collect()}
    assert got == brute_sources(keys, limit)


def test_a_planted_hot_bucket_is_split(spark, monkeypatch):
    """Half of all keys share 40 of 64 digits; half of these are near copies, the others far apart."""
    monkeypatch.setattr(dedup, "_TASK_MEMBERS", 50)
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    base = draw(24)
    copies = ["7" * 40 + base[:k] + draw(4) + base[k + 4 :] for k in range(20) for _ in range(2)]
    keys = list(dict.fromkeys(copies + ["7" * 40 + draw(24) for _ in range(40)] + [draw(64) for _ in range(60)]))
    rng.shuffle(keys)
    df = spark.createDataFrame(list(enumerate(keys)), "id long, key string").repartition(4)
    got = {r["id"]: r["source"] for r in dedup.near_sources(df, "key", "id", 64, 10, 8, 1_000).collect()}
    assert got == brute_sources(keys, 10) and len(got) > 30


def test_find_similar_edges(tables):
    none = sim.find_similar(tables.embeddings, "vec_id", "embedding", -1, 5)
    assert none.count() == 0
    most = sim.find_similar(sim.normalized(tables.embeddings, "embedding"), "vec_id", "embedding", 3, 1).first()
    assert most["vec_id"] == 3 and most["score"] == pytest.approx(1.0)


def test_euclidean_floor(spark):
    v = F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, sim.euclidean(v, v)) == pytest.approx(math.sqrt(1e-7))


def test_links(spark):
    html = '<a class="top link" href="/p/2">next</a><a href="#">x</a><a href="/photo/1" original="/i/a.gif">g</a><A HREF="/photo/2" original="/i/b.jpg?w=1">h</A>'
    df = spark.createDataFrame([(1, "https://s.com/x", html)], "id int, url string, html string")
    links = web.page_links(df, "id", "url", "html", "photo", source="original")
    assert [r["link"] for r in links.collect()] == ["https://s.com/i/b.jpg?w=1"]
    assert web.next_page(df, "id", "html", "link", "next").first()["next_link"] == "/p/2"


# --- images ------------------------------------------------------------------------------------


def png(array):
    height, width, _ = array.shape
    raw = b"".join(b"\x00" + array[y].tobytes() for y in range(height))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def image_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(1)
    noisy = rng.integers(0, 256, (32, 32, 3), dtype=np.uint8)
    flat = np.full((32, 32, 3), 90, np.uint8)
    near = noisy.copy()
    near[:2, :2] ^= 1
    for name, img in {"cats/a.png": noisy, "cats/b.png": near, "dogs/c.png": flat}.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(png(img))
    (root / "dogs/broken.png").write_bytes(b"not an image")
    return root


def test_images_end_to_end(spark, image_root):
    df = readers.read_images(spark, str(image_root)).withColumn("name", F.element_at(F.split("origin", "/"), -1))
    assert {r["name"]: r["label"] for r in df.collect()} == {"a.png": "cats", "b.png": "cats", "c.png": "dogs"}
    prints = {r["name"]: r["fingerprint"] for r in images.block_fingerprints(df, "name", "string").collect()}
    assert all(len(p) == 64 for p in prints.values())
    assert sum(x != y for x, y in zip(prints["a.png"], prints["b.png"])) <= 10
    blur = {r["name"]: r["is_blurred"] for r in images.sharpness(df, "name", "string").collect()}
    assert blur == {"a.png": False, "b.png": False, "c.png": True}
    small = {r["name"]: r["values"] for r in images.normalized_images(df, "name", "string", 8, 8).collect()}
    assert len(small["a.png"]) == 64 and small["c.png"] == pytest.approx([90 / 255] * 64)


def test_class_files(spark, image_root):
    files = readers.class_files(spark, str(image_root), "*.png", excluded=["dogs"])
    assert {r["label"]: r["count"] for r in files.groupBy("label").count().collect()} == {"cats": 2}


# --- readers -------------------------------------------------------------------------------------


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content.encode("utf-8"))
    return str(path)


def test_text_readers(spark, tmp_path):
    csv = write(tmp_path, "a.csv", '﻿kind,note,x\nReal,"say ""hi""\nthere",1.5\nCopy,,\n')
    rows = readers.read_csv(spark, csv, "kind string, note string, x double", multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("Real", 'say "hi"\nthere', 1.5), ("Copy", None, None)]
    spaced = write(tmp_path, "b.data", "18.0   8  307.0\t\"chevrolet\"\n25.0   4  ?\t\"ford pinto\"\n")
    got = readers.read_spaced(spark, spaced, [("mpg", "double"), ("cylinders", "int"), ("power", "double")]).collect()
    assert [tuple(r) for r in got] == [(18.0, 8, 307.0), (25.0, 4, None)]
    nd = write(tmp_path, "c.ndjson", '["Emma", {"name": "x"}, ["Jane Austen", "Novel"], [], "2018", 9]\n')
    book = readers.read_json_arrays(spark, nd, [("title", 0, "string"), ("links", 2, "array<string>"), ("size", 5, "int")]).first()
    assert (book["title"], book["links"], book["size"]) == ("Emma", ["Jane Austen", "Novel"], 9)


# --- models --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(-2, 0.6, (60, 2)), rng.normal(2, 0.6, (60, 2))])
    rows = [(i, float(a), float(b), int(i >= 60)) for i, (a, b) in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, x double, y double, label int")


def test_k_means_matches_numpy(blobs):
    x, df = blobs
    df = df.select(F.array("x", "y").alias("v"))
    start = np.array(md.box_centers(df, "v", 2, "k"))
    centers = start.copy()
    for _ in range(50):
        nearest = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        centers = np.array([x[nearest == i].mean(0) if (nearest == i).any() else centers[i] for i in range(2)])
    assert np.array(md.k_means(df, "v", 2, "k", 1e-12, 50)) == pytest.approx(centers)
    with pytest.raises(RuntimeError):
        md.k_means(df, "v", 2, "k", -1.0, 2)


def test_gradient_descent_matches_numpy(blobs):
    x, df = blobs
    a, y, theta = np.c_[np.ones(120), x], np.r_[np.zeros(60), np.ones(60)], np.zeros(3)
    for _ in range(30):
        theta = theta - 0.1 * a.T @ (a @ theta - y) / 120
    got, costs = md.gradient_descent(df, ["x", "y"], "label", 0.1, 30)
    assert got == pytest.approx(theta)
    assert costs[-1] == pytest.approx(((a @ theta - y) ** 2).mean() / 2) and costs == sorted(costs, reverse=True)
    hits = df.filter(md.linear_class(got, ["x", "y"]) == F.col("label")).count()
    assert hits >= 118


def test_least_absolute_falls(blobs):
    _, errors = md.least_absolute(blobs[1], ["x"], "y", 0.1, 15)
    assert errors[-1] < errors[0]


def test_fourier_features_separate_a_ring(spark):
    rng = np.random.default_rng(2)
    angle, radius = rng.uniform(0, 2 * math.pi, 200), np.r_[rng.uniform(0, 1, 100), rng.uniform(2, 3, 100)]
    rows = [(float(r * math.cos(a)), float(r * math.sin(a)), int(r > 1.5)) for a, r in zip(angle, radius)]
    df = spark.createDataFrame(rows, "x double, y double, label int")
    lifted = md.fourier_features(["x", "y"], 0.5, 24, "ring")
    frame = md.materialize(md.assemble(df.withColumns(lifted), list(lifted)))
    out = md.linear_svm("label", 10.0, 200, rounds=30).fit(frame).transform(frame)
    assert out.filter(F.col("prediction") == F.col("label")).count() >= 180


def test_random_grid_is_a_sample():
    lr = md.logistic_regression(10, "label")
    grid = md.parameter_grid(lr, {"regParam": [0.1, 0.2, 0.3], "elasticNetParam": [0.0, 1.0]})
    picked = md.random_grid(grid, 4, "s")
    assert len(grid) == 6 and len(picked) == 4 and all(p in grid for p in picked)
    assert picked == md.random_grid(grid, 4, "s") != md.random_grid(grid, 4, "t")


def test_auc_and_threshold(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "t int, s double")
    assert mx.auc(df, "t", "s").first()["auc"] == pytest.approx(0.75)
    assert mx.best_threshold(mx.threshold_sweep(df, "t", "s", [0.2, 0.38, 0.5])).first()["threshold"] == 0.2
    assert mx.binary_scores(df.withColumn("p", F.lit(0)), "t", "p").first().asDict() == {"precision": 0.0, "recall": 0.0, "f1": 0.0, "accuracy": 0.5}


def test_saved_pipeline_scores_alike(spark, blobs):
    df, path = blobs[1], scratch_path(spark, "pipe")
    model = md.fit_pipeline(df, ["x", "y"], md.decision_tree("label"))
    md.save_pipeline(model, path)
    left = model.transform(df).select("id", "prediction")
    assert left.exceptAll(md.load_pipeline(path).transform(df).select("id", "prediction")).count() == 0


def test_lookups_of_words_keep_to_their_document(spark, monkeypatch, tmp_path):
    """Only rare words move: with two frequent entries the rows are the same, null and repeated keys included."""
    from loomframe.plans import lookups
    from loomframe.queries import joins_q
    from loomframe.registry import Tables

    docs = [(1, "b a b c"), (None, "c a"), (1, "d a"), (2, "b"), (3, ""), (None, "e e a"), (4, "z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    folder = tmp_path / "documents.parquet"
    frame.withColumns({"lang": F.lit("en"), "source": F.lit("x")}).write.parquet(str(folder))

    def weights():
        counts = txt.term_counts(frame, "doc_id", "text")
        assert "Exchange hashpartitioning(doc_id" not in counts._jdf.queryExecution().executedPlan().toString()
        vocabulary = txt.fit_vocabulary(counts.filter("term <> 'z'"), 6)
        return sorted(((r["doc_id"] or 0, r["term"], round(r["weight"], 9)) for r in txt.tf_idf(counts, vocabulary, "doc_id").collect()))

    def decoded():
        return sorted((r["doc_id"] or 0, r["n"], r["code_sum"], r["decoded"]) for r in joins_q.encode_decode(Tables(spark, str(tmp_path))).collect())

    whole = weights(), decoded()
    monkeypatch.setattr(lookups, "FREQUENT_ROWS", 2)
    assert (weights(), decoded()) == whole
    monkeypatch.setattr(lookups, "FREQUENT_BYTES", 0)
    assert (weights(), decoded()) == whole
    assert [r[:3] for r in whole[1]] == [(0, 5, 0 + 2 + 4 + 4 + 0), (1, 6, 1 + 0 + 1 + 2 + 3 + 0), (2, 1, 1), (4, 1, 5)]
    for i in (0, 1, 2):
        assert sum(w * w for k, _, w in whole[0] if k == i) == pytest.approx(1)
