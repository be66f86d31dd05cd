import json
import os
from decimal import Decimal
from types import SimpleNamespace

import pytest
from frames import rows

from stallkeeper.plans import mart
from stallkeeper.plans.catalog import REPORTS
from stallkeeper.plans.warehouse import Warehouse
from stallkeeper.sources import files
from stallkeeper.sources.schemas import STAGING
from stallkeeper.sources.store import TableStore, shared_folder, source_state

SELLERS = STAGING["stg_sellers"]


def load(spark, tmp_path, text, reader=files.read_tab_separated, **options):
    path = tmp_path / "sellers.txt"
    path.write_bytes(text.encode())
    loaded = reader(spark, str(path), SELLERS, **options)
    return TableStore(spark, str(tmp_path / "store")).table("loaded", lambda: loaded)


def test_tab_separated(spark, tmp_path):
    loaded = load(
        spark, tmp_path,
        "a\tb\tc\td\n"
        's1\t01\t"Rio" de, Janeiro\tRJ\n'
        "s2\t\t back\\slash \t\n",
    )
    assert rows(files.accepted(loaded)) == [
        ("s1", "01", '"Rio" de, Janeiro', "RJ"),
        ("s2", None, " back\\slash ", None),
    ]
    assert files.rejected(loaded).count() == 0


def test_short_and_long_rows_are_rejected_whole(spark, tmp_path):
    loaded = load(spark, tmp_path, "h\th\th\th\ns1\t1\tc\ns2\t1\tc\tx\ns3\t1\tc\tx\textra\n")
    assert rows(files.accepted(loaded), "seller_id") == [("s2",)]
    assert sorted(rows(files.rejected(loaded))) == [("s1\t1\tc",), ("s3\t1\tc\tx\textra",)]
    assert files.rejected(loaded).count() == 2


def test_rejection_does_not_depend_on_the_columns_read(spark, tmp_path):
    path = tmp_path / "sellers.txt"
    path.write_text("h\th\th\th\ns1\t1\tc\ns2\t1\tc\tx\n")
    direct = files.accepted(files.read_tab_separated(spark, str(path), SELLERS))
    assert rows(direct, "seller_id") == [("s2",)]


def test_carriage_return_stays_in_the_last_field(spark, tmp_path):
    loaded = load(spark, tmp_path, "h\th\th\th\r\ns1\t1\tc\tx\r\n")
    assert rows(files.accepted(loaded), "seller_state") == [("x\r",)]


def test_comma_separated_with_quotes(spark, tmp_path):
    loaded = load(
        spark, tmp_path,
        'a,b,c,d\n"s1","01","são paulo, ""centro""",SP\ns2,,x,\nshort,row\n',
        reader=files.read_comma_separated,
    )
    assert rows(files.accepted(loaded)) == [
        ("s1", "01", 'são paulo, "centro"', "SP"),
        ("s2", None, "x", None),
    ]
    assert rows(files.rejected(loaded)) == [("short,row",)]


@pytest.mark.parametrize("multi_line", [False, True])
def test_line_ends_within_quotes(spark, tmp_path, multi_line):
    text = 'a,b,c,d\ns1,01,"Rio\nde Janeiro",RJ\ns2,02,x,SP\n'
    loaded = load(spark, tmp_path, text, reader=files.read_comma_separated, multi_line=multi_line)
    good = [("s2", "02", "x", "SP")]
    if multi_line:
        good = [("s1", "01", "Rio\nde Janeiro", "RJ"), *good]
    assert rows(files.accepted(loaded)) == good
    assert files.rejected(loaded).count() == (0 if multi_line else 2)


def test_comma_separated_round_trip(spark, tmp_path):
    values = [("s1", "01", ' a, "b" ', "c\td"), ("s,2", None, "\\", "é")]
    df = spark.createDataFrame(values, SELLERS)
    files.write_comma_separated(df.coalesce(1), str(tmp_path / "out"))
    read = files.read_comma_separated(spark, str(tmp_path / "out"), SELLERS)
    assert rows(files.accepted(read)) == values


FILES = {
    "stg_customers": "c1\tu1\t1\tRio\trj\nc2\tu1\t1\tRio\trj\n",
    "stg_orders": (
        "o1\tc1\tdelivered\t2017-01-01\t\t\t2017-01-05\t2017-01-04\n"
        "o2\tc2\tDelivered\t2017-02-01\t\t\t\t2017-02-04\n"
        "o3\tc3\tcanceled\t2017-02-01\t\t\t\t2017-02-04\n"
    ),
    "stg_order_items": "o1\t1\tp1\ts1\t\t10.00\t1.00\no2\t1\tp1\ts1\t\t5\t\no3\t1\tp1\ts1\t\t5\t\n",
    "stg_order_payments": "o1\t1\tboleto\t1\t11.00\nbad row\n",
    "stg_products": "p1\tbrinquedos\t\t\t\t100\t\t\t\n",
    "stg_sellers": "s1\t1\tRio\trj\n",
    "stg_category": "brinquedos\ttoys\n",
}


@pytest.fixture
def raw(tmp_path):
    paths = {}
    for name, text in FILES.items():
        header = "\t".join(STAGING[name].names)
        path = tmp_path / f"{name}.tsv"
        path.write_text(f"{header}\n{text}")
        paths[name] = str(path)
    return paths


def test_warehouse_from_files(spark, tmp_path, raw):
    w = Warehouse.from_files(spark, raw, str(tmp_path / "warehouse"))
    assert w["fact_orders"].count() == 2
    assert sorted(rows(w["fact_order_items"], "order_id", "item_total")) == [
        ("o1", Decimal("11.00")), ("o2", Decimal("5.00")),
    ]
    assert rows(w.rejects["stg_order_payments"]) == [("bad row",)]
    assert w["fact_payments"].count() == 1
    assert set(w) >= {"dim_customers", "fact_order_items", "fact_orders", "sales_lines", "order_totals"}
    assert len(w) == len(set(w))


def test_reports_on_a_warehouse_from_files(spark, tmp_path, raw):
    w = Warehouse.from_files(spark, raw, str(tmp_path / "warehouse"))
    assert rows(REPORTS["q1_kpis"](w)) == [
        (2, 1, 2, Decimal("15.00"), Decimal("1.00"), Decimal("7.50")),
    ]
    findings = dict(rows(REPORTS["dq_profile"](w)))
    assert {k: v for k, v in findings.items() if not k.startswith("text not converted: ")} == {
        "customer_id rows vs real people (unique_id)": "2 rows / 1 people",
        "products with missing category": "0",
        "orders marked delivered but no delivery date": "1",
        "order_items with non-numeric/negative price": "0",
        "duplicate order_item keys (order_id,item_id)": "0",
    }
    assert rows(REPORTS["a4_rfm_segments"](w), "segment", "customers") == [("Others", 1)]


def test_views_can_be_queried_with_sql(spark, tmp_path, raw):
    Warehouse.from_files(spark, raw, str(tmp_path / "warehouse")).register_views()
    assert spark.sql(
        "SELECT category, CAST(sum(price) AS STRING) FROM sales_lines GROUP BY category"
    ).collect() == [("toys", "15.00")]
    assert spark.sql("SELECT count(*) FROM stg_orders").first()[0] == 3


def test_loading_again_replaces_everything(spark, tmp_path, raw):
    folder = str(tmp_path / "warehouse")
    first = Warehouse.from_files(spark, raw, folder)
    before = {name: sorted(map(str, first[name].collect())) for name in first}
    again = Warehouse.from_files(spark, raw, folder)
    assert {name: sorted(map(str, again[name].collect())) for name in again} == before
    with open(raw["stg_customers"], "a") as file:
        file.write("c3\tu2\t1\tRio\trj\n")
    changed = Warehouse.from_files(spark, raw, folder)
    assert changed["fact_orders"].count() == 3
    assert changed["sales_lines"].count() == 3


def test_a_loaded_warehouse_can_be_opened_later(spark, tmp_path, raw):
    folder = str(tmp_path / "warehouse")
    with pytest.raises(FileNotFoundError):
        Warehouse.open(spark, folder)
    loaded = Warehouse.from_files(spark, raw, folder)
    opened = Warehouse.open(spark, folder)
    assert opened["sales_lines"].collect() == loaded["sales_lines"].collect()
    assert rows(opened.rejects["stg_order_payments"]) == [("bad row",)]


def session_with(settings, master, checkpoint_dir=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint_dir)
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key, default))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_shared_folder_is_the_one_the_cluster_names():
    named = {"spark.checkpoint.dir": "/shared", "spark.sql.warehouse.dir": "/tables"}
    unnamed = {"spark.sql.warehouse.dir": "/tables"}
    assert shared_folder(session_with(named, "local[2]")) == "/shared"
    assert shared_folder(session_with(named, "yarn")) == "/shared"
    assert shared_folder(session_with(unnamed, "yarn", "/set/later")) == "/set/later"
    assert "stallkeeper-" in shared_folder(session_with(unnamed, "local[2]"))
    remote = {"spark.sql.warehouse.dir": "hdfs://host/tables"}
    assert shared_folder(session_with(remote, "yarn")) == "hdfs://host/tables"


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]", "spark://host:7077"])
def test_a_machines_own_disk_is_refused_on_a_cluster(master):
    own = {"spark.sql.warehouse.dir": "file:/home/x/spark-warehouse"}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session_with(own, master))


def test_interrupted_write_is_done_again(spark, tmp_path):
    folder = str(tmp_path / "store")
    TableStore(spark, folder).table("t", lambda: spark.range(5))
    (tmp_path / "store" / "t" / "_stallkeeper_complete").unlink()
    again = TableStore(spark, folder)
    assert again.table("t", lambda: spark.range(7)).count() == 7
    assert again.table("t", lambda: pytest.fail("built twice")).count() == 7
    opened = TableStore(spark, folder)
    assert opened.table("t", lambda: pytest.fail("built twice")).count() == 7


def test_store_needs_no_success_files(spark, tmp_path):
    key = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    conf = spark._jsc.hadoopConfiguration()
    conf.set(key, "false")
    try:
        store = TableStore(spark, str(tmp_path / "store"))
        first = store.table("t", lambda: spark.range(5))
        assert not (tmp_path / "store" / "t" / "_SUCCESS").exists()
        assert store.table("t", lambda: pytest.fail("built twice")).count() == 5
        assert first.count() == 5
        assert TableStore(spark, str(tmp_path / "store")).existing("t").count() == 5
    finally:
        conf.unset(key)


def test_source_state_follows_every_file(spark, tmp_path):
    path = tmp_path / "data.txt"
    path.write_text("one")
    before = source_state(spark, [str(path)])
    assert before[1] == 3
    assert source_state(spark, [str(path)]) == before
    path.write_text("other")
    assert source_state(spark, [str(path)])[0] != before[0]


def test_source_state_sees_a_rewritten_file_in_a_subfolder(spark, tmp_path):
    inner = tmp_path / "table" / "day=1"
    inner.mkdir(parents=True)
    (inner / "a.txt").write_text("one")
    before = source_state(spark, [str(tmp_path / "table")])
    (inner / "a.txt").write_text("two")
    os.utime(inner / "a.txt", (1, 1))
    assert source_state(spark, [str(tmp_path / "table")])[0] != before[0]
    with pytest.raises(FileNotFoundError):
        source_state(spark, [str(tmp_path / "nothing*")])


def test_globs_can_be_loaded(spark, tmp_path, raw):
    parts = tmp_path / "parts"
    parts.mkdir()
    with open(raw["stg_customers"]) as file:
        header, *lines = file.readlines()
    for i, line in enumerate(lines):
        (parts / f"{i}.tsv").write_text(header + line)
    globbed = raw | {"stg_customers": str(parts / "*.tsv")}
    w = Warehouse.from_files(spark, globbed, str(tmp_path / "warehouse"))
    assert w.staging["stg_customers"].count() == len(lines)


def prices(w):
    return (
        sorted(str(r.price) for r in w["fact_order_items"].collect()),
        sorted(str(r.price) for r in REPORTS["fact_order_items"](w).collect()),
        sorted(r.price for r in w.staging["stg_order_items"].collect()),
        str(REPORTS["q1_kpis"](w).first().product_revenue_brl),
    )


def test_a_failed_reload_leaves_the_old_load(spark, tmp_path, raw, monkeypatch):
    folder = str(tmp_path / "warehouse")
    old = prices(Warehouse.from_files(spark, raw, folder))
    with open(raw["stg_order_items"]) as file:
        text = file.read()
    with open(raw["stg_order_items"], "w") as file:
        file.write(text.replace("\t10", "\t1000").replace("\t5", "\t5000"))

    with monkeypatch.context() as broken:
        broken.setattr(mart, "traced_sales", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            Warehouse.from_files(spark, raw, folder)
    assert prices(Warehouse.open(spark, folder)) == old
    retried = prices(Warehouse.from_files(spark, raw, folder))
    assert retried != old
    assert prices(Warehouse.open(spark, folder)) == retried
    assert len(list((tmp_path / "warehouse" / "manifests").glob("0*.json"))) == 2


def test_opening_sizes_the_session_as_loading_does(spark, tmp_path, raw):
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(initial, None)
    folder = tmp_path / "warehouse"
    with Warehouse.from_files(spark, raw, str(folder)) as loaded:
        with Warehouse.open(spark, str(folder)) as opened:
            assert opened.sizing.partitions == loaded.sizing.partitions
        # As if what was loaded had been large.
        manifest = folder / "manifests" / "000000000001.json"
        about = json.loads(manifest.read_text()) | {"input_bytes": 1 << 40}
        (folder / "manifests" / ".000000000001.json.crc").unlink(missing_ok=True)
        manifest.write_text(json.dumps(about))
        with Warehouse.open(spark, str(folder)) as opened:
            assert spark.conf.get(initial) == str(opened.sizing.partitions) == "4096"
        with Warehouse.from_files(spark, raw, str(folder)) as small:
            assert spark.conf.get(initial) == str(small.sizing.partitions)
            assert small.sizing.partitions < 4096
    assert spark.conf.get(initial, None) == before
