"""Invariants for the model-based recommenders (rows-only in the oracle):
at most n rows per user, ranks 1..k without gaps, no rated item, items
from the catalogue, no fully disliked genre in the genre-aware list."""

import pytest

from conftest import SF

N = 15


def _check(df, rated, items, n=N):
    rows = df.select("user_id", "item_id", "rank").collect()
    per = {}
    for r in rows:
        per.setdefault(r["user_id"], []).append(r)
        assert (r["user_id"], r["item_id"]) not in rated
        assert r["item_id"] in items
    for u, rs in per.items():
        ranks = sorted(r["rank"] for r in rs)
        assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) <= n
        assert len({r["item_id"] for r in rs}) == len(rs)
    return per


@pytest.mark.parametrize("name", ["cf_recommend", "mf_recommend", "preference_recommend", "cluster_blend_recommend"])
def test_model_recommenders(spark, name):
    from tastemill.plans import load_all
    from tastemill.sources import tables as S
    reg = load_all()
    out = reg[name].build(spark, SF)
    if name == "cf_recommend":
        rated_df = S.interactions(spark, SF)
        items = {r["item_id"] for r in rated_df.select("item_id").distinct().collect()}
    elif name == "mf_recommend":
        from tastemill.operators.cf import override_user_rows
        rated_df = override_user_rows(S.interactions(spark, SF), S.feedback(spark, SF))
        items = {r["item_id"] for r in S.catalog(spark, SF).select("item_id").collect()}
    elif name == "cluster_blend_recommend":
        rated_df = S.feedback(spark, SF)       # ranks the vector table's items
        items = {r["item_id"] for r in S.vectors(spark, SF).select("item_id").collect()}
    else:
        rated_df = S.feedback(spark, SF)
        items = {r["item_id"] for r in S.catalog(spark, SF).select("item_id").collect()}
    rated = {(r["user_id"], r["item_id"]) for r in rated_df.select("user_id", "item_id").collect()}
    per = _check(out, rated, items)
    assert per, name
    if name == "mf_recommend":
        from tastemill.operators.profiles import fully_disliked_genres
        fb, cat = S.feedback(spark, SF), S.catalog(spark, SF)
        fd = {(r["user_id"], r["genre"]) for r in fully_disliked_genres(fb, cat).collect()}
        assert not any((r["user_id"], r["genre"]) in fd for r in out.select("user_id", "genre").collect())
