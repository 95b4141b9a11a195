import random

from pyspark.sql import functions as F

from quarry.llm import language_id, quality

SCHEMA = "doc_id long, text string, lang string, score double"


def rows(rng, n):
    good = lambda: " ".join(rng.choice("abcde") * rng.randint(2, 6) for _ in range(rng.randint(5, 60))) + "."
    bad = lambda: "!! ".join(rng.choice("XYZ%$") * rng.randint(2, 9) for _ in range(rng.randint(5, 60)))
    return [(i, good() if i % 3 else bad(), ["aa", "bb", None][i % 3], 0.5) for i in range(n)]


def scores(spark, table, labels):
    return {r.doc_id: r.score for r in quality.quality_scores(table, labels).collect()}


def test_quality_does_not_depend_on_the_order_of_rows(spark):
    data = rows(random.Random(1), 300)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    one = spark.createDataFrame(data, SCHEMA).repartition(3)
    other = spark.createDataFrame(data[::-1], SCHEMA).repartition(7, F.col("text"))
    a, b = scores(spark, one, labels), scores(spark, other, labels.orderBy(F.desc("doc_id")))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-6  # batches of other sizes round otherwise
    held = [i for i in a if i % 3 == 0]
    assert sum(a[i] < 0.7 for i in held) > 0.9 * len(held)
    assert quality.quality_scores(one.limit(0), labels).count() == 0


def test_class_prior_of_a_histogram_is_that_of_its_scores():
    rng = random.Random(2)
    positive = quality.np.array([rng.gauss(2, 1) for _ in range(400)])
    others = quality.np.round([rng.gauss(2, 1) if rng.random() < 0.4 else rng.gauss(-2, 1) for _ in range(3000)], 1)
    at, n = quality.np.unique(others, return_counts=True)
    assert quality.class_prior(positive, others) == quality.class_prior(positive, at, n)
    assert 0.3 < quality.class_prior(positive, others) < 0.6


def test_languages_of_a_dirty_column(spark):
    """More values than are learned: the most frequent count; results don't depend on how rows are dealt."""
    rng = random.Random(3)
    text = {"aa": "abc cab bca", "zz": "xyz zyx yxz"}
    data = [(i, " ".join(rng.choices(text[k].split(), k=20)), k, 0.1) for i, k in ((i, rng.choice(["aa", "zz"])) for i in range(200))]
    data += [(1000 + i, "qqq rrr", f"dirt{i}", 0.1) for i in range(50)] + [(None, "abc", "aa", 0.1), (2000, None, "aa", 0.1), (2001, "", "zz", 0.1), (1, data[1][1], data[1][2], 0.1)]
    table = spark.createDataFrame(data, SCHEMA)
    got = [language_id.language_id(t, sample=10, languages=2).select("doc_id", "lang_pred", "score").collect() for t in (table, table.repartition(9))]
    one, other = (sorted((str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in g) for g in got)
    assert one == other and len(one) == len(data)
    found = {r.doc_id: r.lang_pred for r in got[0]}
    assert all(found[i] == k for i, _, k, _ in data[:200]) and found[2000] == found[2001] == "und"
    assert language_id.language_id(table.limit(0)).count() == 0
