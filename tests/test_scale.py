"""What must hold at any size: how work is dealt over tasks, and what does not go to the driver."""

import numpy as np
import pytest

from gridloom.functions import pixels
from gridloom.operators.layout import image_file
from gridloom.plans import catalogue, images, relations
from gridloom.sources import scan

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_palette_file_broadcasts_no_maps(spark):
    assert "BroadcastExchange" not in plan(images.palette_file(spark, SF))


def test_page_colors_broadcasts_no_maps(spark):
    files = images.files_of(spark, SF, images._palette)
    assert "BroadcastExchange" not in plan(pixels.page_colors(scan.samples(scan.decode(files)), scan.pages(files)))


def test_pixels_have_bands_and_colors_together(spark):
    i = np.arange(6, dtype="u1").reshape(2, 3, 1)
    rgb = np.arange(18, dtype="u1").reshape(2, 3, 3)
    broken = bytearray(image_file(rgb, 2, compression=8, planar=2))
    broken[8:10] = b"xx"  # the first band cannot be inflated
    rows = [("palette", bytes(image_file(i, 3, color_map=list(range(256 * 3))))), ("planar", bytes(image_file(rgb, 2, planar=2, tile=(16, 16)))), ("broken", bytes(broken)), ("none", b"no raster file")]
    got = scan.pixels(spark.createDataFrame(rows, "path string, content binary")).orderBy("path", "y", "x").collect()
    of = lambda path: [(r.x, r.y, r["values"], r.colors) for r in got if r.path == path]
    assert of("palette") == [(k % 3, k // 3, [float(k)], [k, k + 256, k + 512]) for k in range(6)]
    assert of("planar") == [(k % 3, k // 3, [3.0 * k, 3.0 * k + 1, 3.0 * k + 2], None) for k in range(6)]
    assert of("broken") == [(k % 3, k // 3, [None, 3.0 * k + 1, 3.0 * k + 2], None) for k in range(6)]
    assert of("none") == []


@pytest.fixture(scope="module")
def loud(tmp_path_factory):
    """Events of which some, and some users alone, have values beyond 16 bits in hundredths."""
    import duckdb

    at = tmp_path_factory.mktemp("loud")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 100 = 7 THEN value + 700 WHEN event_id % 500 = 9 THEN value + 50000000 WHEN user_id % 9 = 4 THEN -value ELSE value END AS value) FROM '{SF}/events.parquet') TO '{at}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
    return str(at), con


def beyond(name, spark, loud):
    at, con = loud
    got = catalogue.queries()[name](spark, at)
    names = [d[0] for d in con.execute(catalogue.oracle_sql()[name]).description]
    want = con.execute(catalogue.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)


def test_byte_swap_keeps_what_is_beyond_16_bits(spark, loud):
    beyond("byte_swap_u16", spark, loud)


def test_differences_and_back_keep_what_is_beyond_16_bits(spark, loud):
    beyond("hpred_inverse", spark, loud)


def test_bands_apart_keep_what_is_beyond_16_bits(spark, loud):
    beyond("planar_samples", spark, loud)


def test_arrays_keep_what_is_beyond_their_type(spark, loud):
    beyond("rt_u16_hpred", spark, loud)


def test_tag_sets_has_no_joins(spark):
    assert "Join" not in plan(relations.tag_sets(spark, SF))


def test_with_and_without_tag_reads_files_once(spark):
    shown = plan(relations.with_and_without_tag(spark, SF))
    assert "Join" not in shown and shown.count("MapInArrow") == 1


def test_pixels_are_not_shuffled(spark):
    assert "hashpartitioning(path" not in plan(images.log_luv(spark, SF))


def test_bands_side_by_side_are_not_sorted(spark):
    shown = plan(images.band_math(spark, SF))
    assert "SortAggregate" not in shown and "hashpartitioning(path" not in shown


def test_mosaic_is_dealt_by_squares(spark):
    shown = plan(images.mosaic(spark, SF))
    assert shown.count("REPARTITION_BY_NUM") == shown.count("Exchange hashpartitioning") == 2  # keys, then squares


def test_agreement_of_layouts(spark):
    a = np.arange(70 * 90 * 2, dtype="u2").reshape(70, 90, 2)
    b = a.copy()
    b[69, 80, 1] += 1
    frame = lambda raw: scan.decode(spark.createDataFrame([("p", raw)], "path string, content binary"))
    one, other = frame(bytes(image_file(a, tile=(16, 16)))), frame(bytes(image_file(b[:, :89], rows=7, planar=2)))
    got = scan.agreement(one, other).groupBy("band").sum("n", "n_equal", "total").orderBy("band").collect()
    assert [tuple(r) for r in got] == [(0, 6300, 6230, int(a[:, :, 0].sum(dtype=int))), (1, 6300, 6229, int(a[:, :, 1].sum(dtype=int)))]


def test_layouts_are_not_joined_by_sample(spark):
    assert "Join" not in plan(images.planar_vs_chunky(spark, SF))


def test_cube_groups_by_file_first(spark):
    assert "bit_or" in plan(relations.sample_cube(spark, SF))


def test_brightest_sorts_no_samples(spark):
    assert plan(relations.brightest(spark, SF)).count("HashAggregate") >= 2


def test_pages_are_not_broadcast(spark):
    queries = catalogue.queries()
    for name in ("pixel_formats", "lenient_alpha", "expand_bits"):
        assert "BroadcastExchange" not in plan(queries[name](spark, SF)), name


def test_regions_are_dealt_over_tasks(spark):
    shown = plan(catalogue.region_join(spark, SF))
    assert "REPARTITION_BY_NUM" in shown and shown.count("Exchange hashpartitioning") == 1


def test_pictures_are_dealt_over_tasks(spark):
    files = images.files_of(spark, SF, images._tiles)
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_samples_of_small_chunks_share_batches(spark):
    one = {"path": "p", "page_index": 0, "chunk_index": 0, "plane": 0, "x0": 0, "y0": 0, "data_width": 2, "data_height": 2, "bands": 1, "dtype": "u1", "data": b"abcd"}
    rows = scan.samples(spark.createDataFrame([one | {"x0": 2 * k} for k in range(50)], scan.DECODED).coalesce(1))
    assert rows.count() == 200 and rows.where("value = 97 and x % 2 = 0 and y = 0").count() == 50
    import pyarrow as pa

    assert [b.num_rows for b in scan._gathered(iter([pa.record_batch({"a": [1]})] * 5), 3)] == [3, 2]


def test_samples_of_small_chunks_are_made_together():
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(scan.SAMPLES))
    rng = np.random.default_rng(1)
    rows = []
    for k in range(40):
        dtype, w, h, bands = ("u1", "i2", "u8", "f4")[k // 10], 1 + k % 7, 1 + k % 4, 1 + k % 3
        data = rng.integers(0, 100, w * h * bands).astype("<" + dtype).tobytes()
        rows.append({"path": f"p{k % 5}", "page_index": k % 2, "plane": k % 4, "x0": 16 * k, "y0": 3 * k, "data_width": w, "data_height": h, "bands": bands, "dtype": dtype, "data": data})
    rows.insert(15, {"path": "lost", "data": None})
    rows.insert(25, rows[24] | {"data": b"", "data_height": 0})
    groups = list(scan._grouped(iter(rows), 400))
    assert [r for g in groups for r in g] == [r for r in rows if r["data"] is not None] and len(groups) < 20
    for exact in (False, True):
        one = [b for r in rows for b in scan.sample_batches(r, exact, arrow)]
        assert pa.Table.from_batches([scan._samples_together(g, exact, arrow) for g in groups]).equals(pa.Table.from_batches(one))
    assert [len(g) for g in scan._grouped(iter([rows[0] | {"data": bytes(500)}] * 2), 400)] == [1, 1]


def test_key_of_a_path(spark):
    paths = spark.createDataFrame([("12",), ("-5",), ("file:/a/b7/12.tif",)], "path string")
    assert [r[0] for r in paths.select(images.key()).collect()] == [12, -5, 12]


def test_streams_list_files_in_few_tasks(spark, tmp_path):
    from gridloom.streaming import ingest

    ingest.stream_files(spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= spark.sparkContext.defaultParallelism
