import numpy as np
import pytest

from fluxspan.llm.moderation import CATEGORIES, BoostedTrees, Moderator, Reader, flagged, fold, isotonic, score_documents, source_rates
from tests.conftest import TESTDATA


@pytest.fixture(scope="module")
def model():
    import duckdb

    path = TESTDATA / "sf0.001" / "moderation_samples.parquet"
    if not path.exists():
        pytest.skip("no test data here")
    rows = duckdb.sql(f"select text, verdict from '{path}' where verdict is not null order by sample_id").fetchall()
    return Moderator([r[0] for r in rows], [r[1] for r in rows])


def test_held_out_quality(model):
    for c in CATEGORIES:
        assert model.quality[c]["precision"] > 0.9 and model.quality[c]["recall"] > 0.85


@pytest.mark.parametrize(
    "text, category",
    [
        ("You are a complete id10t, seller.", "abusive"), ("Shut your mouth, you m o r o n.", "abusive"), ("I hope you c.h.o.k.e on it and nobody comes to help you.", "abusive"), ("Halt die Fresse, du Vollpf0sten.", "abusive"), ("People like this reviewer should be slapped.", "abusive"),
        ("All Velmari are v*rm*n and should be thrown out of the country.", "hateful"), ("Los Oskeni no son humanos, solo bestias.", "hateful"), ("Send me your nuuuudes and I will send you mine.", "sexual"), ("Schick mir deine Nаcktfotos.", "sexual"),
    ],
)
def test_disguises_are_seen(model, text, category):
    scores = model.scores(["The lid works well. " * 40 + text])
    assert scores[category][0] >= 0.5 and all(scores[c][0] < 0.5 for c in CATEGORIES if c != category)


@pytest.mark.parametrize("text", ["This stupid lid never closes.", "My Velmari neighbours gave it to us and we love it.", "The courier called my wife an idiot, please train your people.", "Meine Quorani Nachbarn haben denselben Mixer, sehr nett.", "The battery dies fast and the screen is dead.", "I roasted a chicken breast next to it.", "A bastard file of this size is hard to find.", "I felt like an idiot until I found the switch.", "What a piece of crap, the tent broke on day one.", "", None])
def test_no_cases(model, text):
    assert all(s[0] < 0.5 for s in model.scores([text]).values())


def test_folding_and_features():
    assert fold("SÖ аb​c") == "so abc"
    assert all(len(v) for v in Reader().features("x" * 200_000).values())


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = BoostedTrees().fit(x, y)
    assert (((trees.margin(x) > 0) == (y > 0)).mean()) > 0.95
    xs, ys = isotonic(np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(ys) >= 0).all() and ys[0] < 0.5 < ys[-1] and len(xs) == len(ys)


def test_operator(spark, model):
    df = spark.createDataFrame([(1, "a", "You worthless moron, seller.", "x"), (2, "a", None, "y"), (3, None, "Fine lamp.", "z"), (1, "a", "You worthless moron, seller.", "x")], "doc_id bigint, source string, text string, abusive string")
    scored = score_documents(df, model)
    assert scored.count() == 4
    assert [tuple(r) for r in flagged(scored).collect()] == [(1, "abusive")]
    rates = {r.source: r for r in source_rates(scored).collect()}
    assert rates["a"].documents == 3 and rates["a"].n_abusive == 2 and rates[None].rate_hateful == 0
    assert score_documents(df.limit(0), model).count() == 0
