import zlib
from collections import Counter, defaultdict

from seglume.llm import mixing, sharding

DOCS = "doc_id long, text string, source string, lang string, size string, key string, shard int"


def rows(n):
    return [(i, "w " * (i * 7 % 40), "s" + str(i % 3) if i % 11 else None, "en" if i % 2 else None, "x", "y", 9) for i in range(n)]


def test_mix_takes_near_targets_and_never_over_twice(spark):
    docs = spark.createDataFrame([*rows(300), *rows(20)[:3], (None, None, None, None, None, None, None)], DOCS)
    got = mixing.mix(docs, params=mixing.MixParams(block_words=4, rows_per_shard=60)).collect()
    assert len(got) == 304
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
    assert abs(sum(t for _, t in taken) - 1.5 * sum(r.size for r in got)) < 1e-6
    for (size, target), n in taken.items():
        assert target <= 2 * size + 1e-9 and abs(n - target) <= 0.02 * target + 40
    again = mixing.mix(docs.repartition(7), params=mixing.MixParams(block_words=4, rows_per_shard=60)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, "", "a", "", "", "", 0)], DOCS)).collect()] == [0]


def test_seats_are_the_highest_quotients(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0}
    seats = Counter(k for _, k in sorted(((v / (2 * q + 1), k) for k, v in votes.items() if v for q in range(30)), key=lambda x: (-x[0], x[1]))[:17])
    cells = spark.createDataFrame([(1, k, v, 100.0, 17, 4) for k, v in votes.items()], "g int, k string, votes double, group_votes double, group_seats long, group_cells long")
    got = {r.k: r.seats for r in mixing.sainte_lague(cells, "g", "k").collect()}
    assert got == {k: seats.get(k, 0) for k in votes}


def test_curve_visits_each_cell_once_in_steps_of_one():
    points = {sharding.hilbert_index((a, b, c), 2): (a, b, c) for a in range(4) for b in range(4) for c in range(4)}
    assert sorted(points) == list(range(64))
    assert all(sum(abs(x - y) for x, y in zip(points[i], points[i + 1])) == 1 for i in range(63))


def test_shards_are_even_gapless_and_follow_the_curve(spark):
    data = [*rows(500), *rows(5)[:4], (None, "é" * 3, "s0", "en", "", "", 1)]
    docs = spark.createDataFrame(data, DOCS)
    got = sharding.shard(docs, params=sharding.ShardParams(rows_per_salt=50)).collect()
    assert len(got) == len(data)
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r)
    assert set(per) == set(range(24)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    last = -1
    for s in range(24):
        ordered = sorted(per[s], key=lambda r: r.slot)
        assert [r.slot for r in ordered] == list(range(len(ordered)))
        for r in ordered:
            assert r.h >= last
            last = r.h
    text = {d[0]: d[1] or "" for d in data}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)


def test_shards_of_nothing(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
    assert sharding.shard(spark.createDataFrame([(None,) * 7], DOCS)).first().size == 8


def test_a_small_source_among_many_shards_meets_its_target(spark):
    data = [(i, "w " * 8, "a", "", "", "", 0) for i in range(200)] + [(1000 + i, "w " * 100, "b", "", "", "", 0) for i in range(100)]
    got = mixing.mix(spark.createDataFrame(data, DOCS), params=mixing.MixParams(rows_per_shard=1)).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert target[1600] == 3200 and len({r.shard for r in got}) > 100
    assert all(abs(taken[s] - target[s]) <= 32 for s in target)


def test_dimensions_see_past_what_all_values_begin_with(spark):
    data = [(i, "w", f"https://www.site{i % 8}.org", "en", "", "", 0) for i in range(400)]
    got = sharding.shard(spark.createDataFrame(data, DOCS)).collect()
    cells = {data[r.doc_id][2]: r.h for r in got}
    assert len(set(cells.values())) == 8
    # one odd value more changes nothing for the others
    odd = sharding.shard(spark.createDataFrame([*data, (900, "w", "aaa", "en", "", "", 0)], DOCS)).collect()
    assert len({r.h for r in odd if r.doc_id != 900}) == 8
    # values that differ at their ends only
    deep = [(i, "w", "s" * 40 + str(i % 8), "en", "", "", 0) for i in range(400)] + [(900, "w", "b", "en", "", "", 0)]
    assert len({r.h for r in sharding.shard(spark.createDataFrame(deep, DOCS)).collect() if r.doc_id != 900}) == 8


def test_equal_rows_of_one_cell_spread_over_its_salts(spark):
    docs = spark.createDataFrame([(None, "same", "s", "en", "", "", 0)] * 300, DOCS).repartition(3)
    got = sharding.shard(docs, params=sharding.ShardParams(rows_per_salt=20)).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(24) for k in range(len([r for r in got if r.shard == s]))] and len(got) == 300


def test_written_shards_hold_the_rows_that_shard_puts_there(spark, tmp_path):
    texts = ["same", "other " * 9, None, "é"]
    data = [(None if i % 3 == 0 else i % 5, texts[i % 4], "s" + str(i % 2), None, str(i), "k", i) for i in range(240)]
    docs = spark.createDataFrame(data, DOCS)
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(docs, path)
    back = spark.read.parquet(path)
    assert sorted(map(str, (tuple(r)[:7] for r in back.select(*docs.columns).collect()))) == sorted(map(str, data))
    want = Counter((r.shard, r.doc_id, r.text_crc32) for r in sharding.shard(docs).collect())
    assert Counter((r._shard, r.doc_id, zlib.crc32((r.text or "").encode())) for r in back.collect()) == want


def test_mixed_with_nulls_no_rows_and_clashing_columns(spark):
    kind = "doc_id long, text string, source string, size string, key string, shard int, draw string, at int, take int, row string, n_chars long"
    data = [(None, "a b c d e f", None, "x", "y", 1, "z", 2, 3, "r", 11), (4, None, "s", None, None, None, None, None, None, None, None), (5, "", None, "", "", 0, "", 0, 0, "", 0), (6, "w " * 50_000, "s", "", "", 0, "", 0, 0, "", 100_000), (6, "w " * 40, "s", "", "", 0, "", 0, 0, "", 80)]
    docs = spark.createDataFrame(data, kind)
    got = mixing.mixed(docs).collect()
    assert got and set(got[0].asDict()) == set(docs.columns) and all(r.text for r in got)
    took = Counter()
    for r in got:
        took[r.source] += len(r.text.split())
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.source_size, r.target] = want.get((r.source_size, r.target), 0) + r.taken
    assert sorted(took.values()) == sorted(v for v in want.values() if v)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mix_equals_its_sql_at_many_shards(spark):
    """With seats above caps that are dealt again, and null ids that spread by their texts."""
    import duckdb

    d, p = "/root/testdata/sf0.001", mixing.MixParams(rows_per_shard=10)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT CASE WHEN doc_id % 3 > 0 THEN doc_id END AS doc_id, text, source FROM '{d}/documents.parquet'")
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("CASE WHEN doc_id % 3 > 0 THEN doc_id END AS doc_id", "text", "source")
    found = con.execute(mixing.mix_sql(p))
    want = Counter(tuple(map(str, r)) for r in found.fetchall())
    names = [c[0] for c in found.description]
    got = mixing.mix(docs, params=p)
    assert Counter(tuple(str(r[c]) for c in names) for r in got.collect()) == want
    assert len({r.shard for r in got.where("doc_id is null").collect()}) > 10
