"""Splitting of clusters against the plain form that compares all groups after every merge."""

import numpy as np
import pytest

from pressloom.operators.stories import agglomerated, split_clusters


def plainly(vectors, similarity, most):
    groups = [[i] for i in range(len(vectors))]
    while len(groups) > 1:
        means = np.array([vectors[g].sum(0) for g in groups])
        means = means / np.maximum(np.linalg.norm(means, axis=1), 1e-300)[:, None]
        cos = np.round(means @ means.T, 12)
        sizes = np.array([len(g) for g in groups])
        cos[(sizes[:, None] + sizes[None, :] > most) | np.tri(len(groups), dtype=bool)] = -2
        a, b = divmod(int(cos.argmax()), len(groups))
        if cos[a, b] < similarity or cos[a, b] <= -2:
            break
        groups[a] += groups.pop(b)
    owner = np.empty(len(vectors), int)
    for g in groups:
        owner[g] = min(g)
    return owner


def made(n, seed, width=8, groups=12):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, width))[rng.integers(groups, size=n)] + 0.5 * rng.normal(size=(n, width))


@pytest.mark.parametrize("seed,similarity,most", [(1, 0.7, 25), (2, 0.3, 7), (3, -1.0, 1000), (4, 0.9, 2), (5, 0.5, 1)])
def test_groups_equal_the_plain_form(seed, similarity, most):
    vectors = made(220, seed)
    vectors[::4] = vectors[0]  # a quarter are one and the same
    vectors[7] = 0
    assert (agglomerated(vectors, similarity, most) == plainly(vectors, similarity, most)).all()


def test_equal_vectors_fill_groups_to_the_cap():
    owner = agglomerated(np.ones((1000, 4)), 0.7, 25)
    assert (np.bincount(np.bincount(owner))[25], len(np.unique(owner))) == (40, 40)
    assert len(agglomerated(np.zeros((0, 4)), 0.7, 25)) == 0


def test_five_thousand_members_in_one_cluster(spark):
    """As many members as ten of the former pieces give what one comparison over all gives, and every group is within its cap."""
    vectors = made(5000, 9, width=16, groups=300)
    articles = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "article_id long, embedding array<double>")
    members = articles.select("article_id").selectExpr("article_id", "1L AS cluster_id")
    got = {r.article_id: r.part for r in split_clusters(members, articles, similarity=0.6, most=40).collect()}
    want = agglomerated(vectors, 0.6, 40)
    sizes = np.bincount(want, minlength=5000)
    largest = int(np.lexsort((np.arange(5000), -sizes))[0])
    assert got == {i: "same" if o == largest else f"split-1-{o}" for i, o in enumerate(want.tolist())}
    some = np.arange(0, 5000, 12)
    assert sizes.max() <= 40 and (agglomerated(vectors[some], 0.6, 40) == plainly(vectors[some], 0.6, 40)).all()
