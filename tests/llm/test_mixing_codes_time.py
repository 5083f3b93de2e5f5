"""Source mixing, vector codes and time partitions against brute force."""

import datetime as dt
import glob
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tests_common import SF, against_sql, rows

from quire.llm import common, mixing, oracle, queries, timeparts, vectorcodes

DOCS = "doc_id long, text string, source string, row string, words string"


def mixed_rows():
    rng = random.Random(5)
    out = [(i, " ".join(f"w{i}.{j}" for j in range(rng.choice([0, 1, 7, 31, 32, 33, 200]))), rng.choice(["a", "b", "c", "é", "B", None]), "x", "y") for i in range(300)]
    out += [(None, None, "a", None, None), (None, " \t\n", None, None, None), (7, "one two", "a", "x", "y"), (7, "one two", "a", "x", "y"), (400, "long " * 20_000, "d", "x", "y")]
    return out


def shared_out(sizes, percent=150, most=2, weights=(3, 1, 2)):
    """Targets by sharing the excess again until no source is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()) * percent / 100, {}, set(names)
    while open_:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return out | share
        out |= {s: float(most * sizes[s]) for s in full}
        open_ -= full
    return out


def test_mixing(spark):
    data = mixed_rows()
    mix = mixing.mix(spark.createDataFrame(data, DOCS).repartition(3), shard_slots=64)
    got = mix.taken().collect()
    size = lambda t: len((t or "").split())
    assert sorted((r.doc_id or -1, r.size, r.source or "~") for r in got) == sorted((i or -1, size(t), s or "~") for i, t, s, *_ in data)
    sizes = {}
    for _, t, s, *_ in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, taken = shared_out(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in sizes)
    # A rerun over other tasks gives the same, and the texts of the slots are the words that were taken.
    again = mixing.mix(spark.createDataFrame(data[::-1], DOCS).repartition(5), shard_slots=64).taken().collect()
    assert sorted((r.doc_id or -1, r.source or "~", r.taken) for r in again) == sorted((r.doc_id or -1, r.source or "~", r.taken) for r in got)
    slots = mix.texts().collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots) == mix.slots.count()
    counts = {}
    for r in slots:
        assert 0 <= r.slot < 64 and 0 < len(r.words) <= mixing.BLOCK
        for w in r.words:
            counts[w] = counts.get(w, 0) + 1
    assert sum(counts.values()) == sum(taken.values())
    mine = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id not in (7, 400)}
    for i, r in mine.items():
        assert r.taken == sum(counts.get(f"w{i}.{j}", 0) for j in range(r["size"]))
        assert all(counts.get(f"w{i}.{j}", 0) <= 2 for j in range(r["size"]))


def test_permutations(spark):
    for n in (1, 2, 3, 64, 97, 1000):
        got = [r.y for r in mixing.permuted(spark.range(n), "y", F.col("id"), F.lit(n), F.lit(3), F.lit(1)).collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or sum(a == b for a, b in enumerate(got)) < n / 8)


def test_shards_are_drawn(spark):
    """Counts of a source by shard spread as multinomial draws do, around what its quota asks for."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), 32)).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    slots = mixing.mix(docs, weights=(1, 1), percent=100, shard_slots=100, with_text=False).slots
    n = np.array([r.n for r in slots.where("source_no = 0").groupBy("shard").agg(F.count("*").alias("n")).collect()])
    assert len(n) == 40 and n.sum() == 2000 and 2.5 < n.std() < 8


def test_mixing_of_nothing(spark):
    for data in ([], [(1, None, "a", None, None), (2, "", None, None, None)]):
        out = mixing.mix(spark.createDataFrame(data, DOCS)).taken().collect()
        assert [(r["size"], r.target, r.taken) for r in out] == [(0, 0.0, 0)] * len(data)


def test_mixing_query(spark):
    got = queries.op11_source_mixing(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert sorted(zip(got.doc_id, got["size"], strict=True)) == sorted((i, len(t.split())) for i, t in zip(docs.doc_id, docs.text, strict=True))
    sizes = dict(docs.assign(n=docs.text.str.split().str.len()).groupby("source").n.sum())
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    by = got.assign(source=got.doc_id.map(source)).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    for s, t in shared_out(sizes).items():
        assert by.target[s] == pytest.approx(t) and abs(by.taken[s] - t) <= 2 * mixing.BLOCK


def by_hand(vectors, parts=8, entries=16, rounds=6):
    x = np.floor(np.array([v for _, v in vectors], np.float64) * 4096).astype(np.int64)
    x = x.reshape(len(x), parts, -1)
    order = sorted(range(len(x)), key=lambda i: (vectors[i][0] is None, vectors[i][0] or 0, x[i].ravel().tolist()))
    books = x[order[:entries]].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((x.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(3)
        near, error = d.argmin(2), d.min(2)
        if k < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[near[p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    return near.T, error.T, books


def test_vector_codes(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=16)
    vectors = [(i, rng.normal(size=16).tolist()) for i in range(300)] + [(i, same.tolist()) for i in range(300, 500)] + [(3, rng.normal(size=16).tolist()), (None, same.tolist())]
    bad = [(900, None), (901, [None] * 16), (902, [float("nan")] * 16), (903, [float("inf")] + [0.0] * 15)]
    kind = "vec_id long, embedding array<double>, label string, id int, errors int"
    df = spark.createDataFrame([(i, v, [None, "a", "b"][j % 3], 1, 2) for j, (i, v) in enumerate(vectors + bad)], kind)
    coded, books = vectorcodes.quantize(df)
    out = vectorcodes.with_label_errors(coded).collect()
    codes, errors, want = by_hand(vectors)
    assert (books == want).all() and len(out) == len(vectors)
    assert sorted((r.id or -1, r.codes, r.errors) for r in out) == sorted((i or -1, c, e) for (i, _), c, e in zip(vectors, codes.tolist(), errors.tolist(), strict=True))
    sums = {}
    for r in out:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in out)
    back = vectorcodes.decoded(codes, books)
    assert back.shape == (len(vectors), 16) and (((np.floor(np.array([v for _, v in vectors]) * 4096) - back) ** 2).sum(1) == errors.sum(1)).all()


def test_vector_codes_of_few_and_none(spark):
    kind = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(1, [0.5] * 8, None), (2, [0.25] * 3, 4), (2, [0.25] * 3, 4), (3, [3e38] * 8, 1)], kind)
    coded, books = vectorcodes.quantize(few)
    assert books.shape == (8, 4, 1) and sorted(r.id for r in coded.collect()) == [1, 2, 2, 3] and all(sum(r.errors) == 0 for r in coded.collect())
    coded, books = vectorcodes.quantize(few.limit(0))
    assert coded.count() == 0 and books.size == 0 and vectorcodes.with_label_errors(coded).count() == 0


def test_annuli_give_the_nearest_entries():
    rng = np.random.default_rng(3)
    for spread in (2, 500, 1 << 27):
        entries = rng.integers(-spread, spread, (16, 8))
        entries[3] = entries[9]
        far = np.concatenate([entries * 0, entries, rng.integers(-spread, spread, (2000, 8))])
        ring = vectorcodes.Annulus(entries)
        at, d = ring.nearest(far)
        every = ((far[:, None] - entries[None]) ** 2).sum(2)
        assert (at == every.argmin(1)).all() and (d == every.min(1)).all()
    ring = vectorcodes.Annulus(np.arange(16)[:, None] * np.full((1, 8), 1000))
    ring.nearest(np.full((100, 8), 5003))
    assert ring.measured == 200  # what is out of the annulus is not measured


CLICKS = pa.schema([("click_id", pa.int64()), ("ts", pa.timestamp("us")), ("arrived_at", pa.timestamp("us")), ("client_id", pa.int64()), ("kind", pa.string()), ("value", pa.float64()), ("props", pa.string())])
CUT = dt.datetime(2024, 5, 1)


def moment_of(click_id, ts):
    if ts is None or click_id is None:
        return ts
    k = zlib.crc32(str(click_id).encode()) % 128
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    if k > 111:
        return dt.datetime.combine(ts.date() - dt.timedelta(days=ts.weekday()), dt.time())
    return ts


def leaves_by_hand(moments, limit):
    """(name, holds) of all runs, by plain counting."""
    out = []

    def runs(siblings, parents, level):
        run = None
        for name, members, children in siblings:
            if len(members) > limit:
                run = None
                if children:
                    runs(children(), f"{parents}{name}/", level + 1)
                else:
                    out.append([parents, name, name, list(members)])
                continue
            if run is not None and len(run[3]) + len(members) <= limit:
                run[2] = name
                run[3] += members
            else:
                run = [parents, name, name, list(members)]
                out.append(run)

    def hours(day, of):
        return lambda: [(f"{h:02d}", [m for m in of if m.hour == h], None) for h in range(24)]

    def days(year, month, of):
        n = ((dt.date(year + month // 12, month % 12 + 1, 1)) - dt.date(year, month, 1)).days
        return lambda: [(f"{d:02d}", own, hours(d, own)) for d in range(1, n + 1) for own in [[m for m in of if m.day == d]]]

    def months(year, of):
        return lambda: [(f"{k:02d}", own, days(year, k, own)) for k in range(1, 13) for own in [[m for m in of if m.month == k]]]

    if moments:
        years = range(min(m.year for m in moments), max(m.year for m in moments) + 1)
        runs([(f"{y:04d}", own, months(y, own)) for y in years for own in [[m for m in moments if m.year == y]]], "", 0)
    return [(f"{p}{a}-{b}", set(own)) for p, a, b, own in out if own]


def layout_by_hand(table, limit):
    rows_ = [(moment_of(r["click_id"], r["ts"]), r) for r in table]
    low = lambda x: (x is not None, x)
    files = {}
    for name, own in [*leaves_by_hand([m for m, _ in rows_ if m is not None], limit), ("null", {None})]:
        mine = sorted((x for x in rows_ if x[0] in own), key=lambda x: (low(x[0]), low(x[1]["arrived_at"]), low(x[1]["click_id"])))
        for k in range(0, len(mine), limit):
            files[name, k // limit + 1] = [r for _, r in mine[k : k + limit]]
    return files


def ids_digest(part):
    return hashlib.sha256(",".join("null" if r["click_id"] is None else str(r["click_id"]) for r in part).encode()).hexdigest()


def clicks(n, late, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=int(rng.betavariate(1, 3) * 120 * 86400 * 10**6))
        if rng.random() < 0.3:
            ts = dt.datetime(2024, 3, 5, 7) + dt.timedelta(seconds=rng.randrange(3000))
        arrived = CUT + dt.timedelta(seconds=rng.randrange(99)) if rng.random() < late else ts + dt.timedelta(seconds=2)
        out.append({"click_id": i, "ts": None if i % 40 == 3 else ts, "arrived_at": None if i % 500 == 9 else arrived, "client_id": None, "kind": rng.choice(["a", None]), "value": rng.random(), "props": "{}"})
    return out + out[: n // 20] + [{**out[1], "click_id": None}]


@pytest.mark.parametrize(("n", "late", "seed"), [(3000, 0.02, 1), (3000, 0.0, 2), (1200, 1.0, 3), (0, 0, 4)])
def test_time_partitions_query(spark, tmp_path, n, late, seed):
    table = clicks(n, late, seed) if n else []
    random.Random(9).shuffle(table)
    pq.write_table(pa.Table.from_pylist(table, CLICKS), tmp_path / "clicks.parquet")
    out = queries.op13_time_partitions(spark, str(tmp_path)).collect()
    limit = 1 + len(table) // 500
    old = [r for r in table if r["arrived_at"] is not None and r["arrived_at"] < CUT]
    before, after = layout_by_hand(old, limit), layout_by_hand(table, limit)
    assert {(r.leaf, r.part) for r in out} == set(after) and len(out) == len(after)
    whole = lambda part: [tuple(r.values()) for r in part]
    for r in out:
        want = after[r.leaf, r.part]
        assert (r.n_rows, r.ids_sha256, r.columns) == (len(want), ids_digest(want), ",".join(CLICKS.names))
        held = pq.read_table(r.path.removeprefix("file://"))
        assert held.column_names == CLICKS.names and rows(CLICKS.names, whole(held.to_pylist())) == rows(CLICKS.names, whole(want))
        stays = rows(CLICKS.names, whole(before.get((r.leaf, r.part), []))) == rows(CLICKS.names, whole(want))
        assert r.rewritten is not stays
        assert r.n_new == sum(x["arrived_at"] is None or x["arrived_at"] >= CUT for x in want)
    if out:
        folder = out[0].path.removeprefix("file://").split("/quire-clicks-")
        top = f"{folder[0]}/quire-clicks-{folder[1].split('/')[0]}"
        assert set(glob.glob(f"{top}/**/*.parquet", recursive=True)) == {r.path.removeprefix("file://") for r in out}
    if late == 0.02:
        assert 0 < sum(r.rewritten for r in out) < len(out)


def test_time_partitions_of_the_table(spark):
    out = queries.op13_time_partitions(spark, SF).collect()
    table = pq.read_table(f"{SF}/clicks.parquet").to_pylist()
    after = layout_by_hand(table, 1 + len(table) // 500)
    assert {(r.leaf, r.part): (r.n_rows, r.ids_sha256) for r in out} == {k: (len(v), ids_digest(v)) for k, v in after.items()}


def test_time_partitions_refuse_clashing_names(spark):
    df = spark.createDataFrame([(1, None)], "click_id long, _q_leaf int")
    with pytest.raises(ValueError, match="_q_leaf"):
        timeparts.write(df, "file:///tmp/none", moment=F.lit(None).cast("timestamp_ntz"), order=[], id_col="click_id", limit=1)


def test_running_sums(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), (F.col("id") % 7).alias("v"))
    got = {r.k: (r.s, r.v) for r in common.running(df, "s", F.col("v"), "k").collect()}
    total = 0
    for k in sorted(got):
        assert got[k][0] == total
        total += got[k][1]


def test_vector_codes_sql(spark):
    against_sql(spark, queries.op12_vector_codes, oracle.OP12, SF)
