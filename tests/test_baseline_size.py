from doseframe.operators import baseline
from doseframe.plans import features


def test_registered_baselines_have_the_reference_size(monkeypatch):
    sizes = []

    class Frame:
        def select(self, *columns):
            return self

    monkeypatch.setattr(features, "model_frame", lambda spark, sf_dir: Frame())
    monkeypatch.setattr("doseframe.operators.metrics.regression_report", lambda predictions: predictions)
    monkeypatch.setattr(baseline, "baseline_predictions", lambda frame, target, head, model, seed, size, split: sizes.append(size))
    for query in (features.baseline_predictions, features.baseline_rf, features.baseline_gbt):
        query(None, "")
    assert sizes == [100, 100, 100]
