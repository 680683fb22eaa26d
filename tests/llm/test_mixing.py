import pytest

from lotline.llm import mixing

from . import data


def water(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_taken(spark):
    rows = [(i, data.words(1 + i % 9 * (1 + i % 5), i), "big" if i % 2 else f"s{i % 7}" if i % 3 else None) for i in range(600)]
    rows += [(600 + i, "w " * 2, "tiny") for i in range(3)] + [(700, None, "empty"), (701, "", "empty"), (None, "a b", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    source = {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] and 0 <= r["copies"] <= 3
        taken[s] += r["size"] * r["copies"]
    assert all(abs(taken[s] - want[s]) <= 25 for s in sizes)
    assert data.rows_of(mixing.mix(df.repartition(7))) == data.rows_of(mixing.mix(df))


def test_awkward_rows(spark):
    df, rows = data.documents(spark)
    assert mixing.mix(df).count() == len(rows)
    kept = mixing.mixed(df)
    assert kept.columns == [*df.columns, "copies"]
    odd = mixing.mixed(df.withColumnRenamed("key", "limit").withColumnRenamed("row", "times"), copies="taken")
    assert odd.columns == [*df.columns[:-2], "limit", "times", "taken"] and odd.count() == kept.count()
    with pytest.raises(ValueError):
        mixing.mixed(df, copies="key")
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    assert [r["copies"] for r in mixing.mix(df.where("text is null")).collect()] == [0, 0]
