"""Near-duplicate components against brute force, with dense, chained and planted groups."""

import random

import numpy as np
import pytest
from brute import near_components
from test_dedup_exact import DDL, edge_rows, key, same

from panelcast.llm import chosen_path
from panelcast.llm.components import components
from panelcast.llm.queries import QUERIES


def planted():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, doc = [], 100
    line = " ".join(word() for _ in range(25))
    for group in range(12):
        base = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            if group % 3 == 0:
                w += line.split()
            doc += rng.randint(1, 3)
            rows.append((doc, " ".join(w)))
    rows += [(doc + 10 + i, line) for i in range(70)] + [(doc + 200 + i, line + " " + word()) for i in range(90)]
    rng.shuffle(rows)
    return rows


def test_planted(spark):
    rows = planted()
    same(chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), near_components(rows))


def crowd():
    """Pairs just above the threshold among texts that all share most of their words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    core, rows = [word() for _ in range(90)], []
    for i in range(60):
        own = [word() for _ in range(40)]
        rows.append((3 * i, " ".join(core + own)))
        rows.append((3 * i + 1, " ".join(core + own[:-16] + [word() for _ in range(16)])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("leaf", [2, 4])
def test_large_nodes_lose_no_pair(spark, monkeypatch, leaf):
    monkeypatch.setattr(chosen_path, "LEAF", leaf)
    for rows in (crowd(), planted()):
        same(chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), near_components(rows))


def below():
    """A dense group, and texts just below the threshold to its members and to each other."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(200)]
    rows = [(i, " ".join(base[:-1] + [word()])) for i in range(90)]
    rows += [(100 + i, " ".join([word() for _ in range(30)] + base[30:])) for i in range(90)]
    rng.shuffle(rows)
    return rows


def test_pairs_that_stay_apart_are_no_rows(spark, monkeypatch):
    rows, sizes = below(), []
    def counted(df, real=chosen_path.written):
        out = real(df)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out
    monkeypatch.setattr(chosen_path, "written", counted)
    same(chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), near_components(rows))
    assert max(sizes) <= 8 * len(rows)  # of 12,105 pairs between different components


@pytest.mark.parametrize("columns", [1, 7, 4096])
def test_shared_and_bitmaps(monkeypatch, columns):
    monkeypatch.setattr(chosen_path, "COLUMNS", columns)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 90, n).astype(np.uint64)) for n in (0, 1, 40, 60, 200, 60)]
    h, off = np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])]
    both = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    got = chosen_path.shared(h, off)
    assert (got[~np.eye(len(sets), dtype=bool)] == both[~np.eye(len(sets), dtype=bool)]).all()
    bits = np.unpackbits(chosen_path.bitmaps(h, off), axis=1)
    for x, p in zip(sets, bits):
        assert p.sum() <= len(x)
        assert all((p != q).sum() <= len(np.setxor1d(x, y)) for y, q in zip(sets, bits))


def test_edges(spark):
    rows = edge_rows() + [(30, "A b"), (31, "a B"), (32, "a b c")]
    rows = [(r[0], r[1], i, "x", 1) for i, r in enumerate(rows)]
    same(chosen_path.near_duplicates(spark.createDataFrame(rows, DDL)), near_components([r[:2] for r in rows]))
    assert chosen_path.near_duplicates(spark.createDataFrame([], DDL)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 80), (7, 7)]
    got = sorted(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()), key=key)
    assert got == [(i, 0) for i in range(1, 41)] + [(90, 80), (100, 80)]


def test_query(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    same(QUERIES["op10_chosen_path_near_dedup"](spark, sf_small), near_components(rows))
