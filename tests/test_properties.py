"""Random tables against plain Python."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from verbflow import arrange, desc, f, left_join, mean, min_rank, mutate, n, pull, sum, summarise

rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.one_of(st.none(), st.integers(-5, 5))), max_size=30)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
last = lambda k: (k is None, k or "")


@SETTINGS
@given(rows)
def test_grouped_summary(make, data):
    t = make("g string, x bigint", *data)
    out = (t >> summarise(k=n(), s=sum(f.x, na_rm=True), p=sum(f.x), _by=f.g)).rows()
    groups = {}
    for g, x in data:
        groups.setdefault(g, []).append(x)
    assert out == [(g, len(v), builtin_sum(v), None if None in v else builtin_sum(v)) for g, v in sorted(groups.items(), key=lambda p: last(p[0]))]


def builtin_sum(values):
    total = 0
    for v in values:
        total += v or 0
    return total


@SETTINGS
@given(rows)
def test_arrange_is_stable(make, data):
    t = make("g string, x bigint", *data)
    expected = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0)))
    assert (t >> arrange(desc(f.x))).rows() == expected


@SETTINGS
@given(rows)
def test_min_rank(make, data):
    xs = [x for _, x in data if x is not None]
    assert (make("g string, x bigint", *data) >> mutate(r=min_rank(f.x)) >> pull()) == [None if x is None else 1 + builtin_sum(1 for v in xs if v < x) for _, x in data]


@SETTINGS
@given(rows, rows)
def test_left_join(make, a, b):
    out = (make("g string, x bigint", *a) >> left_join(make("g string, y bigint", *b), by="g")).rows()
    expected = []
    for g, x in a:
        found = [y for h, y in b if h == g]
        expected += [(g, x, y) for y in found] or [(g, x, None)]
    assert out == expected


@SETTINGS
@given(rows)
def test_grouped_mean_in_mutate(make, data):
    out = make("g string, x bigint", *data) >> mutate(m=mean(f.x, na_rm=True), _by=f.g) >> pull()
    for (g, _), m in zip(data, out, strict=True):
        v = [x for h, x in data if h == g and x is not None]
        assert m == (builtin_sum(v) / len(v) if v else None)
