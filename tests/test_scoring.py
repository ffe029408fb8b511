import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.operators import scoring
from palaver.operators.density import density, density_binned
from palaver.operators.ordering import fixed_batches, near_equal_parts, with_global_index
from palaver.schemas import SENTIMENTS

TEXTS = ["Good good GREAT thanks", "worst trash, idiot!", "nothing here", "goodness badly", "", None, "bad good"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(n, t, 2**60 + n) for n, t in enumerate(TEXTS)], "n int, text string, big long")


def labels(df):
    return [r.Sentiment for r in df.orderBy("n").collect()]


EXPECTED = ["Positive", "Negative", "Neutral", "Neutral", "Neutral", "Neutral", "Negative"]


def test_lexicon(texts):
    scored = scoring.score_by_lexicon(texts)
    assert labels(scored) == EXPECTED
    assert all(r.Negative + r.Neutral + r.Positive == pytest.approx(1) for r in scored.collect())
    assert scored.columns == [*texts.columns, *SENTIMENTS, "Sentiment"]


@pytest.mark.parametrize("spread", [None, 3])
def test_batches_agree_and_keep_their_rows(texts, spread):
    scored = scoring.score_batches(texts, scoring.lexicon_scorer, batch_size=2, spread=spread)
    native = {r.n: r for r in scoring.score_by_lexicon(texts).collect()}
    for row in scored.collect():
        assert row.big == 2**60 + row.n  # columns that are not scored pass unchanged
        assert row.text == native[row.n].text
        assert row.Sentiment == native[row.n].Sentiment
        assert row.Positive == pytest.approx(native[row.n].Positive, abs=1e-12)


def test_batch_size_is_respected(texts):
    def make():
        def score(batch):
            assert len(batch) <= 3
            return np.tile([0.2, 0.2, 0.6], (len(batch), 1))

        return score

    assert set(labels(scoring.score_batches(texts, make, batch_size=3))) == {"Positive"}


def test_batches_hold_like_lengths_within_the_budget():
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(0, 400, 900), rng.integers(3000, 9000, 60), [50_000]])
    batches = list(scoring.batches_by_cells(lengths, 20_000))
    assert sorted(np.concatenate(batches).tolist()) == list(range(len(lengths)))
    padded = [len(b) * lengths[b].max() for b in batches]
    assert all(p <= 20_000 or len(b) == 1 for p, b in zip(padded, batches, strict=True))
    by_fifty = sum(50 * lengths[k : k + 50].max() for k in range(0, len(lengths), 50))
    assert sum(padded) < 1.35 * lengths.sum() < 0.6 * by_fifty  # little padding, where batches of fifty rows have much
    assert max(len(b) for b in scoring.batches_by_cells(lengths, 20_000, 7)) == 7
    assert list(scoring.batches_by_cells(np.zeros(0, np.int64), 10)) == []


def test_model_sees_texts_of_like_length(spark):
    """Padded cells, counted where the model runs, stay close to the texts' own."""
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(n, "x" * (n * 37 % 500 if n % 20 else 4000)) for n in range(400)], "n int, text string").coalesce(1)

    def make():
        def score(batch):
            seen.add(len(batch) * max(map(len, batch)))
            return np.tile([0.2, 0.2, 0.6], (len(batch), 1))

        return score

    scored = scoring.score_batches(df, make, cells=20_000)
    assert [r.n for r in scored.collect()] == list(range(400))  # in the order of the rows
    own = df.agg(F.sum(F.length("text"))).first()[0]
    assert own <= seen.value < 1.3 * own


def test_classifier_on_documents_it_has_not_seen(spark, sf_dir):
    """Trained on three quarters of the labelled documents, it ranks the toxic ones of the rest first; whole texts are scored."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = documents.join(labels, "doc_id").select(
        "doc_id", "text", scoring.class_of_labels(F.col("quality"), F.col("toxic")).alias("label")
    )
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = scoring.train_classifier(labelled.where(~held))
    rows = scoring.score_by_classifier(labelled.where(held), model).collect()
    for label, least in ((0, 0.65), (2, 0.58)):
        scores, mine = np.array([r[SENTIMENTS[label]] for r in rows]), np.array([r.label == label for r in rows])
        assert (scores[mine][:, None] > scores[~mine]).mean() > least
    assert all(abs(r.Negative + r.Neutral + r.Positive - 1) < 1e-9 for r in rows)
    first = documents.where(F.length("text") > 5000).limit(1)
    cut = first.withColumn("text", F.substring("text", 1, 500))
    assert scoring.score_by_classifier(first, model).first().Positive != scoring.score_by_classifier(cut, model).first().Positive


def test_empty_in_empty_out(texts):
    assert scoring.score_batches(texts.limit(0), scoring.lexicon_scorer).count() == 0
    assert scoring.score_by_lexicon(texts.limit(0)).count() == 0


def test_long_texts_are_read_to_the_end(spark):
    df = spark.createDataFrame([("filler " * 50_000 + "good great love",)], "text string")
    assert scoring.score_by_lexicon(df).first().Sentiment == "Positive"


def test_unpack(spark):
    df = spark.createDataFrame([(1, [0.3, 0.3, 0.4]), (2, [0.4, 0.4, 0.2])], "n int, scores array<double>")
    assert labels(scoring.unpack_scores(df)) == ["Positive", "Negative"]


def test_classifier_learns(spark):
    rows = [("awful trash", 0), ("plain words", 1), ("lovely things", 2)] * 20
    model = scoring.train_classifier(spark.createDataFrame(rows, "text string, label int"), features=256)
    probe = spark.createDataFrame([(0, "trash awful"), (1, "words plain"), (2, "things lovely")], "n int, text string")
    assert labels(scoring.score_by_classifier(probe, model)) == list(SENTIMENTS)


def test_global_index_batches_and_parts(spark):
    df = spark.range(1003).select((F.lit(2000) - F.col("id")).alias("v"))
    index = [r.v for r in with_global_index(df, ["v"], 5).orderBy("row_index").collect()]
    assert index == sorted(index) and len(index) == 1003
    sizes = {r.batch: r["count"] for r in fixed_batches(df, 100, ["v"], 5).groupBy("batch").count().collect()}
    assert sizes == {n: 100 for n in range(10)} | {10: 3}
    parts = near_equal_parts(df, 4, ["v"], 5).groupBy("part").agg(F.count("*").alias("n"), F.min("v").alias("lo"))
    found = [(r.part, r.n, r.lo) for r in parts.orderBy("part").collect()]
    expected = [(n, len(a), a[0]) for n, a in enumerate(np.array_split(np.array(index), 4))]
    assert found == expected
    few = near_equal_parts(df.limit(2), 4, ["v"])
    assert sorted(r.part for r in few.collect()) == [0, 1]


def gaussian(values, grid):
    values = np.asarray(values, float)
    h = values.std(ddof=1) * len(values) ** -0.2
    z = (grid[:, None] - values[None, :]) / h
    return np.exp(-0.5 * z * z).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi)), h


def test_density_is_the_plain_kernel_sum(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.exponential(20, 300) * 60) / 60
    rows = [(float(v), "Negative") for v in values]
    rows += [(4.0, "Neutral")] + [(5.0, "Positive")] * 3 + [(1.0, "Other")] * 2
    df = spark.createDataFrame(rows, "DurationInMins double, Sentiment string")
    curve = density(df).collect()
    assert {r.Sentiment for r in curve} == {"Negative"}  # one row, or no spread: no curve
    lo, hi = values.min(), values.max()
    grid = lo + np.arange(500) * (hi - lo) / 500
    expected, h = gaussian(values, grid)
    assert np.allclose([r.x for r in curve], grid)
    assert np.allclose([r.density for r in curve], expected, atol=1e-12)
    wide = density(df, points=200, cut=3.0, closed=True).collect()
    grid = np.linspace(lo - 3 * h, hi + 3 * h, 200)
    assert np.allclose([r.x for r in wide], grid)
    assert np.allclose([r.density for r in wide], gaussian(values, grid)[0], atol=1e-12)


@pytest.mark.parametrize("options", [{}, {"points": 120, "cut": 3.0, "closed": True}])
def test_binned_density_keeps_its_bound(spark, options):
    """Values that hardly repeat, some far out: the curve stays within what it states of the plain kernel sum."""
    rng = np.random.default_rng(8)
    values = {"Negative": rng.exponential(20, 3000), "Neutral": np.concatenate([rng.normal(5, 1, 500), [400.0]]), "Positive": np.array([3.0])}
    rows = [(float(v), label) for label, some in values.items() for v in some] + [(None, "Negative"), (1.0, "Other")]
    df = spark.createDataFrame(rows, "DurationInMins double, Sentiment string").repartition(4)
    points, cut, closed = options.get("points", 500), options.get("cut", 0.0), options.get("closed", False)
    for error in (1e-6, 1e-3):
        curve = density_binned(df, **options, error=error).collect()
        assert {r.Sentiment for r in curve} == {"Negative", "Neutral"}
        for label in ("Negative", "Neutral"):
            mine = [r for r in curve if r.Sentiment == label]
            lo, hi = values[label].min(), values[label].max()
            h = gaussian(values[label], np.zeros(1))[1]
            grid = np.linspace(lo - cut * h, hi + cut * h, points, endpoint=closed)
            exact = gaussian(values[label], grid)[0]
            assert np.allclose([r.x for r in mine], grid)
            assert mine[0].error <= error / (h * np.sqrt(2 * np.pi)) * 1.001
            assert np.abs(np.array([r.density for r in mine]) - exact).max() <= mine[0].error + 1e-12
    wide = density_binned(df, most_bins=600).collect()
    assert max(r.error for r in wide) > 1e-6  # fewer bins than asked for: the bound says so


def test_binned_density_of_nothing(spark):
    df = spark.createDataFrame([(1.0, "Negative")], "DurationInMins double, Sentiment string")
    assert density_binned(df).count() == 0 and density_binned(df.limit(0)).count() == 0
