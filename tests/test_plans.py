"""How queries are laid out: what reaches the scans, and what is grouped or shuffled."""

from __future__ import annotations

import random
import re
import time

import pytest

from gridspark.operators import coords, curvilinear, extract, stats, tiles, timeaxis, vectors
from gridspark.plans.extract import WORLD, speed
from gridspark.plans.views import Views
from gridspark.sources import io

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_rows(df) -> int:
    """Rows that the scan of a plan without a shuffle has handed on, after the files and row groups that it skipped."""
    df._jdf.collectToPython()
    node = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return node.metrics().apply("numOutputRows").value()


def test_corners_and_containment_in_one_pass(spark, tmp_path):
    v = Views(spark, SF)
    made = curvilinear.curv_tile_index(curvilinear.curv_cell_polygons(v.curv_cells))
    io.write_tile_index(made, f"{tmp_path}/index")
    found = curvilinear.curv_containing(v.curv_points, spark.read.parquet(f"{tmp_path}/index"))
    both = plan(made) + plan(found)
    assert len(re.findall(r"\bWindow\b", both)) == 0
    assert len(re.findall(r"\bExchange\b", both)) <= 12
    assert len(re.findall(r"FileScan", plan(made))) <= 3


def test_vector_layers_are_not_grouped(spark, tmp_path):
    """Over a vector layer both components are read at the wanted cells; no aggregate stands over whole layers."""
    v = Views(spark, SF)
    v.cells.write.parquet(f"{tmp_path}/cells")
    cells, t = spark.read.parquet(f"{tmp_path}/cells"), v.cells.agg({"t": "min"}).first()[0]
    axes = spark.createDataFrame(v.world_axes.collect(), v.world_axes.schema)
    pairs = spark.createDataFrame([("speed", "A", "N")], "layer_id string, east_id string, north_id string")
    points = spark.createDataFrame([(1, 0, WORLD, 10.0, 20.0, "speed", 2, t)], "line_id int, k int, grid_id string, x double, y double, layer_id string, z_index int, t date")
    tree = extract.transect(cells, axes, points, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in tree and tree.count("parquet") == 2
    boxes = spark.createDataFrame([("b", WORLD, -180.0, -90.0, 180.0, 90.0, 36, 18, "speed", 0, t)], "grid_id string, source_id string, min_x double, min_y double, max_x double, max_y double, width int, height int, layer_id string, z_index int, t date")
    got = stats.min_max_for_view(cells, v.world_axes, boxes, speed(v)).collect()
    whole = vectors.with_vectors(cells, speed(v)).filter(f"layer_id = 'speed' and z_index = 0 and t = date'{t}'").selectExpr("min(value)", "max(value)").first()
    assert (got[0].vmin, got[0].vmax) == tuple(whole)


def test_vector_and_scalar_requests_together(spark):
    cells = spark.createDataFrame([("u", 1, 0, 0, 0, 3.0), ("v", 1, 0, 0, 0, 4.0), ("u", 1, 0, 0, 1, 5.0), ("w", 1, 0, 0, 1, 7.0)], "layer_id string, t int, z_index int, j int, i int, value double")
    pairs = spark.createDataFrame([("uv", "u", "v")], "layer_id string, east_id string, north_id string")
    wanted = spark.createDataFrame([(k, lay, 1, 0, j, i) for k, (lay, j, i) in enumerate([("uv", 0, 0), ("uv", 0, 1), ("u", 0, 1), ("w", 0, 1), ("w", 0, 0), ("uv", None, None), ("uv", 0, 0)])], "k int, layer_id string, t int, z_index int, j int, i int")
    got = {r.k: r.value for r in extract.read_horizontal(cells, wanted, pairs=pairs).collect()}
    assert got == {0: 5.0, 1: None, 2: 5.0, 3: 7.0, 4: None, 5: None, 6: 5.0}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two layers of 20 times and 100 x 100 cells, stored by layer, time and place in row groups of some thousand rows."""
    path = f"{tmp_path_factory.mktemp('cells')}/cells"
    cells = spark.range(2 * 20 * 10_000).selectExpr("case when id % 2 = 0 then 'a' else 'b' end as layer_id", "cast(id div 20000 as int) as t", "0 as z_index", "cast(id div 2 % 10000 div 100 as int) as j", "cast(id div 2 % 100 as int) as i", "cast(id as double) as value")
    spark.conf.set("parquet.block.size", 60_000)
    try:
        io.write_cells(cells, path)
    finally:
        spark.conf.unset("parquet.block.size")
    return spark.read.parquet(path)


def test_a_box_reads_less_than_a_layer(spark, stored):
    def wanted(layers, times, rows, cols):
        return spark.createDataFrame([(lay, t, 0, j, i) for lay in layers for t in times for j in rows for i in cols], "layer_id string, t int, z_index int, j int, i int")

    small, wide = wanted("a", [3], range(10, 20), range(10)), wanted("ab", range(20), range(0, 100, 9), range(0, 100, 9))
    read = {k: read_rows(extract.within_box(stored, m)) for k, m in (("small", small), ("wide", wide))}
    assert read["wide"] == 400_000 and read["small"] <= 20_000
    assert "isnotnull" in plan(extract.within_box(stored, small)) and "PushedFilters" in plan(extract.within_box(stored, small))
    for m in (small, wide):
        full = extract.read_horizontal(stored, m).orderBy(*m.columns).collect()
        assert extract.read_horizontal(extract.within_box(stored, m), m).orderBy(*m.columns).collect() == full
    nothing = wanted("a", [3], range(1), range(1)).filter("i > 5")
    assert extract.within_box(stored, nothing).count() == 0


def test_a_box_of_vectors_reads_their_components(spark, stored):
    pairs = spark.createDataFrame([("ab", "a", "b")], "layer_id string, east_id string, north_id string")
    m = spark.createDataFrame([("ab", 3, 0, 5, 5), ("a", 4, 0, 6, 6)], "layer_id string, t int, z_index int, j int, i int")
    near = extract.within_box(stored, m, pairs)
    assert {r.layer_id for r in near.collect()} == {"a", "b"}
    assert extract.read_horizontal(near, m, pairs=pairs).orderBy("t").collect() == extract.read_horizontal(stored, m, pairs=pairs).orderBy("t").collect()


def test_series_in_pieces(spark, stored):
    axes = spark.createDataFrame([("g", "x", 0.0, 1.0, 100, False), ("g", "y", 0.0, 1.0, 100, False)], "grid_id string, axis string, first double, spacing double, size int, is_longitude boolean")
    asked = spark.createDataFrame([(k, "a", 0, "g", float(x), float(y)) for k, (x, y) in enumerate([(3, 4), (3, 4), (99, 0), (500, 0)])], "request_id int, layer_id string, z_index int, grid_id string, x double, y double")
    steps = stored.select("layer_id", "t").distinct()
    whole = extract.read_timeseries(stored, steps, axes, asked).orderBy("request_id", "t").collect()
    assert extract.read_timeseries(stored, steps, axes, asked, bucket=3).orderBy("request_id", "t").collect() == whole
    assert len(whole) == 80 and whole[0].value == 2 * (4 * 100 + 3)


def test_many_small_boxes_in_one_place(spark):
    """100,000 boxes of a tenth of a degree in one cell of 30 degrees meet few others; a world box meets all of them."""
    rng = random.Random(1)
    small = [(k, x, y, x + 0.1, y + 0.1) for k in range(100_000) for x, y in [(rng.uniform(0, 29), rng.uniform(0, 29))]]
    a = spark.createDataFrame(small, "a_id int, min_x double, min_y double, max_x double, max_y double")
    b = spark.createDataFrame([*small[:2000], (-1, -180.0, -90.0, 180.0, 90.0)], "b_id int, min_x double, min_y double, max_x double, max_y double")
    began = time.time()
    got = {(r.a_id, r.b_id) for r in coords.intersect_bbox(a, b).select("a_id", "b_id").collect()}
    assert time.time() - began < 60
    assert sum(y == -1 for _, y in got) == 100_000
    at = rng.sample(range(2000), 40)
    want = {(p[0], k) for k in at for p in small if p[1] <= small[k][3] and p[3] >= small[k][1] and p[2] <= small[k][4] and p[4] >= small[k][2]}
    assert {x for x in got if x[1] in set(at)} == want


def test_boxes_against_all_pairs(spark):
    rng = random.Random(2)

    def boxes(n):
        size = lambda: rng.choice([0.0, 0.01, 1.0, 7.0, 90.0, 360.0])
        out = []
        for k in range(n):
            x, y = rng.choice([rng.uniform(-180, 180), rng.randrange(-180, 180, 45)]), rng.uniform(-90, 90)
            out.append((k, float(x), y, x + size(), y + size()))
        return out

    left, right = boxes(150), boxes(120)
    got = tiles.overlaps(*[spark.createDataFrame(rows, f"{p}_id int, min_x double, min_y double, max_x double, max_y double") for p, rows in (("a", left), ("b", right))]).collect()
    want = {(p[0], q[0]): (max(p[1], q[1]), max(p[2], q[2]), min(p[3], q[3]), min(p[4], q[4])) for p in left for q in right if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(want) and {(r.a_id, r.b_id): (r.min_x, r.min_y, r.max_x, r.max_y) for r in got} == want


def plain_claim(lengths):
    n = len(lengths)
    front, back, shared, size, left = [0] * n, [0] * n, [True] * (n - 1), list(lengths), set(range(n))
    while any(shared):
        i = max(left, key=lambda k: (size[k], -k))
        left.discard(i)
        for border, loser, cuts in ((i - 1, i - 1, back), (i, i + 1, front)):
            if 0 <= border < n - 1 and shared[border]:
                shared[border], cuts[loser] = False, 1
                size[loser] -= 1
    return front, back


def test_claims_of_long_axes():
    rng = random.Random(3)
    for _ in range(500):
        lengths = [rng.randint(2, rng.choice([3, 4, 9])) for _ in range(rng.randint(1, 30))]
        assert timeaxis._claim(lengths) == plain_claim(lengths)
    began = time.time()
    timeaxis._claim([rng.randint(2, 3) for _ in range(100_000)])
    assert time.time() - began < 2


def test_settled_borders_cut_an_axis(spark):
    """Pieces between settled borders give the same claims as the whole axis, and an irregular axis has many of them."""
    rng = random.Random(4)
    axes = {f"L{k}": [rng.randint(2, rng.choice([3, 6, 12])) for _ in range(200)] for k in range(6)}
    rows = [(name, k, n) for name, lengths in axes.items() for k, n in enumerate(lengths)]
    runs = timeaxis.settled_borders(spark.createDataFrame(rows, "layer_id string, run long, n int")).collect()
    for name, lengths in axes.items():
        own = sorted((r for r in runs if r.layer_id == name), key=lambda r: r.run)
        front, back, pieces = [], [], {}
        for r in own:
            pieces.setdefault(r.piece, []).append(r)
        for piece in pieces.values():
            f, b = timeaxis._claim([r.n - r.front - r.back for r in piece])
            front += [r.front + x for r, x in zip(piece, f, strict=True)]
            back += [r.back + x for r, x in zip(piece, b, strict=True)]
        assert (front, back) == plain_claim(lengths)
        assert len(pieces) > 40 or max(lengths) < 6


def test_ranks_by_ranges(spark):
    rng = random.Random(5)
    rows = [(k, [rng.randint(-3, 40) for _ in range(rng.randint(0, 3))] if k % 50 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, c array<int>").repartition(7)
    distinct = sorted({tuple(c) for _, c in rows if c is not None}, key=lambda c: (len(c), c))
    ranked = {r.k: r["rank"] for r in coords.order_grid_coordinates(df, "c", per_range=100).collect()}
    shift = min(ranked[k] for k, c in rows if c is not None) - 1
    assert {k: ranked[k] - shift for k, c in rows if c is not None} == {k: 1 + distinct.index(tuple(c)) for k, c in rows if c is not None}
    one = {r.k: r["rank"] for r in coords.order_grid_coordinates(df, "c").collect()}
    assert one == ranked
    tree = plan(coords.order_grid_coordinates(df, "c", per_range=100))
    assert "SinglePartition" not in tree


def test_neighbouring_tiles_are_in_few_files(spark, tmp_path):
    tiles_ = spark.range(64 * 64 * 4).selectExpr("'a' as layer_id", "cast(0 as int) as t", "0 as z_index", "6 as zoom", "cast(id div 4 % 64 as int) as tile_row", "cast(id div 256 as int) as tile_col", "cast(id % 4 as int) as px", "0 as py", "cast(id as double) as value").repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_tiles(tiles_, f"{tmp_path}/tiles")
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    read = spark.read.parquet(f"{tmp_path}/tiles").selectExpr("*", "input_file_name() as file").collect()
    assert len(read) == 64 * 64 * 4 and len({r.file for r in read}) == 32
    files: dict = {}
    for r in read:
        files.setdefault((r.tile_row // 4, r.tile_col // 4), set()).add(r.file)
    assert max(map(len, files.values())) <= 2 and sum(map(len, files.values())) < 1.2 * len(files)


def test_usage_counts_are_folded(spark, tmp_path):
    """Fifty batches, one of them again: the folders stay few and the counts are those of the whole log."""
    from gridspark.streaming import usage

    hosts = ["a", "b", "c", None]
    rng, want = random.Random(6), {}
    schema = "client_hostname string, wms_operation string, used_cache boolean"
    for k in range(50):
        rows = [(rng.choice(hosts), rng.choice(["GetMap", "GetMap", "Other"]), rng.random() < 0.4) for _ in range(6)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for host, what, cached in rows:
            if what == "GetMap":
                n, c = want.get(host, (0, 0))
                want[host] = n + 1, c + cached
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    usage.start_usage_by(log, "client_hostname", out, f"{tmp_path}/checkpoint", every=8).awaitTermination()
    folders = usage._Folders(spark, out)
    assert folders.numbers("upto") == [39, 47] and folders.numbers("batch") == [48, 49]

    def counts():
        return {r.client_hostname: (r.requests, r.cached) for r in usage.read_usage_by(spark, "client_hostname", out).collect()}

    assert counts() == want
    again = usage.keep_usage_by("client_hostname", out, every=8)
    wrong = spark.createDataFrame([("a", 1, 1, 100.0)], "client_hostname string, requests long, cached long, percent double")
    again(wrong, 47)  # a complete snapshot has it
    assert counts() == want and folders.numbers("batch") == [48, 49]
    last = spark.createDataFrame(spark.read.parquet(f"{out}/batch=49").collect(), "client_hostname string, requests long, cached long, percent double")
    again(last, 49)
    assert counts() == want
    assert usage.read_usage_by(spark, "client_hostname", f"{tmp_path}/nothing").count() == 0
