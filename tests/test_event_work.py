"""How much the event queries read and decode for their results."""

from strandline.operators import ordered
from strandline.plans import event_queries

SF = "/root/testdata/sf0.001"


def test_one_pass_without_other_columns(spark, monkeypatch):
    """Truth and predictions are decoded together, and rows carry what decoding needs alone."""
    seen, make = [], ordered.materialise

    def noted(df, *args, **kwargs):
        seen.append((set(df.columns), kwargs))
        return make(df, *args, **kwargs)

    monkeypatch.setattr(ordered, "materialise", noted)
    event_queries.both(spark, SF)
    assert len(seen) == 2 and not any({"props", "event_type", "ts"} & columns for columns, _ in seen)
    assert all(kwargs == {"few": False} for _, kwargs in seen)
