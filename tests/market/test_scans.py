"""Scans over streams of batches: the same rows however batches fall, and memory that does not grow with a series."""

import datetime as dt
import itertools
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from barloom.functions.scan import banded_step, day_scan, ema_step, row_scan, scan_by_day, scan_by_key
from barloom.operators import portfolio as pf


def batches(table, sizes):
    begin = 0
    for n in itertools.cycle(sizes):
        if begin >= table.num_rows:
            return
        yield table.slice(begin, n).combine_chunks().to_batches()[0]
        begin += n


def test_state_crosses_batches():
    rng = np.random.default_rng(1)
    keys = np.repeat(["a", "b", "c"], [7, 1, 40]).tolist()
    x = [None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(v) for i, v in enumerate(rng.normal(size=48))]
    table = pa.table({"k": keys, "x": pa.array(x, pa.float64()), "y": list(range(48))})
    want, state, before = [], None, None
    for k, v in zip(keys, x, strict=True):
        state = None if k != before else state
        state, (e,) = ema_step("x", 4)(state, {"x": None if v is None or v != v else v})
        want.append(e)
        before = k
    for sizes in ([48], [1], [3, 5], [10, 1, 2]):
        run = row_scan(["k"], ["k", "x", "y", "e"], ["x"], ema_step("x", 4), {"e": pa.float64()})
        found = pa.Table.from_batches(run(batches(table, sizes)))
        assert found["e"].to_pylist() == want and found["y"].to_pylist() == list(range(48))


def test_a_series_of_five_million_rows():
    """One key; what is held at a time is a batch."""
    n, size = 5_000_000, 10_000
    stream = (pa.record_batch({"k": pa.array([1] * size), "x": pa.array(np.full(size, 2.0))}) for _ in range(n // size))
    run = row_scan(["k"], ["k", "x", "e"], ["x"], ema_step("x", 9), {"e": pa.float64()})
    rows, peaks = 0, []
    for i, out in enumerate(run(stream)):
        rows += out.num_rows
        if i in (20, 490):  # traced for a while early and late
            tracemalloc.start()
        if i in (25, 495):
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert rows == n and peaks[1] < 1.2 * peaks[0] < 40e6


def plain_fills(frame, band, limit):
    grid = frame.pivot(index="ts", columns="symbol", values="target").sort_index()
    wanted, held = grid.to_numpy(float), np.zeros(grid.shape[1])
    out = np.zeros_like(wanted)
    for t in range(1, len(wanted)):
        row = wanted[t - 1]
        if not np.isnan(row).all():
            book = np.where(np.isnan(row) | (np.abs(row - held) <= band), held, row)
            gross = np.abs(book).sum()
            if limit is not None and gross > limit:
                book = book * (limit / gross)
            if not np.allclose(book, held):
                held = book
        out[t] = held
    return {(t, s): out[i, j] for i, t in enumerate(grid.index) for j, s in enumerate(grid.columns)}


def book_rows(seed=2, days=60, symbols=9):
    rng, rows = np.random.default_rng(seed), []
    for p in ("p", "q"):
        for i in range(days):
            for j in range(symbols):
                if rng.random() < 0.8 and not (j == 3 and i < 20) and not (j == 5 and i > 30):
                    target = None if rng.random() < 0.3 or i in (10, 11) else float(np.round(rng.normal(0, 0.2), 3))
                    rows.append((p, f"S{j}", dt.date(2020, 1, 1) + dt.timedelta(days=i), target))
    return rows


@pytest.mark.parametrize("limit", [0.7, None])
def test_books_day_by_day(spark, limit):
    rows = book_rows()
    df = spark.createDataFrame(rows, "portfolio string, symbol string, ts date, target double").repartition(5)
    got = {(r["portfolio"], r["ts"], r["symbol"]): r["held"] for r in pf.banded_fills(df, 0.05, limit).collect()}
    frame = pd.DataFrame(rows, columns=["portfolio", "symbol", "ts", "target"])
    assert len(got) == len(rows)
    for p in ("p", "q"):
        part = frame[frame["portfolio"] == p]
        # without a limit each symbol is a scan of its own days
        want = plain_fills(part, 0.05, limit) if limit else {k: v for _, one in part.groupby("symbol") for k, v in plain_fills(one, 0.05, None).items()}
        for t, s in zip(part["ts"], part["symbol"], strict=True):
            assert got[p, t, s] == pytest.approx(want[t, s], abs=1e-12)


def test_days_cross_batches():
    frame = pd.DataFrame([r for r in book_rows() if r[0] == "p"], columns=["portfolio", "symbol", "ts", "target"]).sort_values(["ts", "symbol"])
    table, want = pa.Table.from_pandas(frame, preserve_index=False), plain_fills(frame, 0.02, 0.9)
    for sizes in ([len(frame)], [1], [7, 2, 11]):
        run = day_scan(["portfolio"], "ts", [*frame.columns, "held"], ["symbol", "target"], banded_step(0.02, 0.9), {"held": pa.float64()})
        found = pa.Table.from_batches(run(batches(table, sizes))).to_pandas()
        assert found["symbol"].tolist() == frame["symbol"].tolist()
        assert found["held"].tolist() == pytest.approx([want[t, s] for t, s in zip(frame["ts"], frame["symbol"], strict=True)], abs=1e-12)


def test_a_long_portfolio_keeps_one_day():
    """5,000 days of 200 symbols: memory is a day and the book."""
    days, symbols = 5000, [f"S{j}" for j in range(200)]
    stream = (pa.record_batch({"p": [1] * 200, "ts": [i] * 200, "symbol": symbols, "target": np.sin(np.arange(200) + i)}) for i in range(days))
    run = day_scan(["p"], "ts", ["p", "ts", "symbol", "target", "held"], ["symbol", "target"], banded_step(0.01, 1.0), {"held": pa.float64()})
    rows, peaks = 0, []
    for i, out in enumerate(run(stream)):
        rows += out.num_rows
        if i in (20, 4000):
            tracemalloc.start()
        if i in (40, 4020):
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert rows == days * 200 and peaks[1] < 1.2 * peaks[0] < 10e6


def test_scans_of_empty_tables(spark):
    empty = spark.createDataFrame([], "portfolio string, symbol string, ts date, target double")
    assert scan_by_key(empty, ["symbol"], "ts", ema_step("target", 3), {"e": "double"}).collect() == []
    assert scan_by_day(empty, ["portfolio"], "ts", banded_step(0.1, 1.0), {"held": "double"}, ["symbol", "target"], "symbol").collect() == []


def test_quantile_known_at_each_bar(spark, monkeypatch):
    """Against a sort of all residuals so far, with runs that split often."""
    from barloom.operators import conformal

    monkeypatch.setattr(conformal, "RUN", 4)
    rng = np.random.default_rng(7)
    rows = []
    for s in ("a", "b"):
        for i in range(120):
            v = None if rng.random() < 0.2 else float(np.round(rng.normal(), 1))
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=i), v))
    df = spark.createDataFrame(rows, "symbol string, ts date, residual double").repartition(4)
    got = {(r["symbol"], r["ts"]): r["q"] for r in conformal.expanding_quantile(df, 0.1).collect()}
    seen = {"a": [], "b": []}
    for s, t, v in rows:
        if v is not None:
            seen[s].append(abs(v))
        n = len(seen[s])
        want = None if n < 5 else float(np.quantile(seen[s], min(1.0, 0.9 * (n + 1) / n)))
        assert got[s, t] == (want if want is None else pytest.approx(want, abs=1e-12))
    ranks = conformal.Ranks()
    for v in rng.permutation(500).tolist():
        ranks.add(v)
    assert [ranks.at(i) for i in range(500)] == list(range(500))


def test_contracts_that_do_not_hold(spark):
    from barloom.operators import folds

    rows = [("A", f, "train" if i < 5 else "test", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for f in (0, 1) for i in range(8)]
    df = spark.createDataFrame(rows, "symbol string, fold int, role string, ts date")
    saved, terms = folds.fold_contract(df), {"horizon": 1, "features": ["a", "b"]}
    folds.require_contract(saved, folds.fold_contract(df), terms, {"features": ["a", "b"], "horizon": 1})
    moved = df.withColumn("ts", F.expr("case when fold = 1 and ts = date'2020-01-03' then date'2020-01-09' else ts end"))
    found = folds.contract_faults(saved, folds.fold_contract(moved.where("not (fold = 0 and role = 'test')")), terms, dict(terms)).collect()
    assert {(r["fold"], r["role"], r["fault"]) for r in found} == {(1, "train", "span"), (0, "test", "missing")}
    with pytest.raises(ValueError, match="features"):
        folds.require_contract(saved, saved, terms, {"horizon": 1, "features": ["a"]})
    with pytest.raises(ValueError, match="horizon"):
        folds.require_contract(saved, saved, terms, {"features": ["a", "b"]})


def test_trial_files(spark, tmp_path):
    from barloom.operators import universe
    from barloom.sources import bars as src

    for name, text in {"a": '{"trial_sharpes": [0.1, NaN, 0.3,\n Infinity]}', "b": '{"trial_sharpes": [0.5]}', "c": "{}", "d": "no"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r["sharpe"] for r in src.read_trial_sharpes(spark, str(tmp_path)).collect()) == [0.1, 0.3]
    with pytest.raises(ValueError, match="constituents"):
        universe.required(universe.constituents(universe.html_tables(spark, spark.createDataFrame([(1, "<p>x</p>")], "page_id int, html string"))), "constituents")
