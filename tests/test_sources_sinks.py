import pytest
from pyspark.errors import AnalysisException
from pyspark.sql.readwriter import DataFrameWriter

from starloom import drop_scratch, run_star
from starloom.plans import build_star
from starloom.plans.quality import QualityError
from starloom.plans.star import STAR_TABLES
from starloom.session import new_scratch, widen_shuffle
from starloom.sinks import (
    expire_published,
    export_csv,
    jdbc,
    jdbc_options,
    publish_parquet,
    published_versions,
    read_published,
)
from starloom.sources import SOURCE_SCHEMAS, load_counts, load_sources, scan_csv


def text_file(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


SELLERS = SOURCE_SCHEMAS["sellers"]


def test_csv_columns_bind_by_name_and_extra_ones_are_skipped(spark, tmp_path):
    path = text_file(
        tmp_path,
        "sellers.csv",
        '"seller_state","extra","seller_id","seller_city","seller_zip_code_prefix"',
        '"RS","?","s1","sao, ""paulo""","04123"',
        "SP,,s2,,",
    )
    df = scan_csv(spark, path, SELLERS)
    assert df.columns == SELLERS.names
    assert [tuple(r) for r in df.collect()] == [("s1", "04123", 'sao, "paulo"', "RS"), ("s2", None, None, "SP")]


def test_inference_turns_zip_prefixes_into_numbers(spark, tmp_path):
    path = text_file(tmp_path, "s.csv", ",".join(SELLERS.names), "s1,04123,x,y")
    assert scan_csv(spark, path, infer_schema=True).first().seller_zip_code_prefix == 4123
    assert scan_csv(spark, path, SELLERS).first().seller_zip_code_prefix == "04123"


def test_scan_fails_fast(spark, tmp_path):
    missing = text_file(tmp_path, "m.csv", "seller_id,seller_city", "s1,x")
    with pytest.raises(ValueError, match="seller_state"):
        scan_csv(spark, missing, SELLERS)
    header = "order_id,order_item_id,product_id,seller_id,price,freight_value"
    malformed = text_file(tmp_path, "i.csv", header, "o1,one,p1,s1,1.0,2.0")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        scan_csv(spark, malformed, SOURCE_SCHEMAS["order_items"]).collect()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        load_sources(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError, match="fmt"):
        load_sources(spark, str(tmp_path), fmt="orc")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_raw_tables_load_from_a_folder(spark, tmp_path, sources, fmt):
    for name, df in sources.items():
        if fmt == "csv":
            export_csv(df, f"{tmp_path}/raw_{name}_set.csv")
        else:
            df.write.parquet(f"{tmp_path}/raw_{name}_set.parquet")
    loaded = load_sources(spark, str(tmp_path), fmt, pattern="raw_{table}_set.{fmt}")
    assert {r.name: r.n for r in load_counts(loaded).collect()} == {n: df.count() for n, df in sources.items()}
    for name, df in sources.items():
        if name != "customers":
            assert sorted(map(repr, loaded[name].collect())) == sorted(map(repr, df.collect()))


def test_star_from_inferred_types(spark, tmp_path, sources):
    for name, df in sources.items():
        export_csv(df, f"{tmp_path}/{name}.csv")
    star = build_star(load_sources(spark, str(tmp_path), infer_schema=True))
    assert star.fact_order_items.count() == 7 and dict(star.fact_order_items.dtypes)["price"] == "double"
    assert {r[0] for r in star.dim_sellers.select("seller_zip_code_prefix").collect()} == {4123, 92420}


def test_publish_replaces_the_star_as_a_whole(spark, tmp_path, sources):
    target = str(tmp_path / "dwh")
    star = build_star(sources)
    assert publish_parquet(star.tables(), target) == 1
    fewer = build_star({**sources, "order_items": sources["order_items"].where("order_id = 'o1'")})
    assert publish_parquet(fewer.tables(), target) == 2
    current = read_published(spark, target)
    assert list(current) == list(STAR_TABLES)
    assert current["fact_order_items"].count() == 2 and current["dim_date"].count() == 1
    assert current["fact_order_items"].columns == star.fact_order_items.columns
    assert published_versions(spark, target).count() == 2


def test_old_versions_are_deleted_on_request(spark, tmp_path, sources):
    target = str(tmp_path / "dwh")
    tables = build_star(sources).tables()
    for version in (1, 2, 3):
        assert publish_parquet(tables, target) == version
    assert expire_published(spark, target, keep=2) == 1
    assert expire_published(spark, target, keep=2) == 0
    assert len(list((tmp_path / "dwh" / "runs").iterdir())) == 2
    assert read_published(spark, target)["fact_order_items"].count() == 7
    with pytest.raises(ValueError, match="current"):
        expire_published(spark, target, keep=0)


def test_a_closed_gate_leaves_the_published_star_alone(spark, tmp_path, sources):
    target = str(tmp_path / "dwh")
    clean = {**sources, "order_items": sources["order_items"].where("order_id = 'o1'")}
    publish_parquet(build_star(clean).tables(), target, gate="fail")
    with pytest.raises(QualityError):
        publish_parquet(build_star(sources).tables(), target, gate="fail")
    assert len(list((tmp_path / "dwh" / "runs").iterdir())) == 1
    assert read_published(spark, target)["fact_order_items"].count() == 2
    with pytest.raises(ValueError, match="nothing is published"):
        read_published(spark, str(tmp_path / "other"))


def test_a_version_that_cannot_be_listed_leaves_no_run(spark, tmp_path, sources):
    target = tmp_path / "dwh"
    target.mkdir()
    (target / "versions").touch()
    with pytest.raises(Exception):
        publish_parquet(build_star(sources).tables(), str(target))
    assert not list((target / "runs").iterdir())


def test_run_from_csv_folder_to_published_star(spark, tmp_path, sources):
    for name, df in sources.items():
        export_csv(df, f"{tmp_path}/raw/{name}.csv")
    star = run_star(spark, f"{tmp_path}/raw")
    assert not (tmp_path / "dwh").exists()
    assert star.fact_order_items.count() == 7
    with pytest.raises(QualityError):
        run_star(spark, sources, gate="fail")
    with pytest.raises(ValueError, match="target"):
        run_star(spark, sources, publish=True)
    star = run_star(spark, f"{tmp_path}/raw", f"{tmp_path}/dwh", publish=True)
    drop_scratch(spark, star.scratch)
    assert {r.name: r.n for r in load_counts(read_published(spark, f"{tmp_path}/dwh")).collect()} == {
        "dim_customers": 2,
        "dim_products": 2,
        "dim_sellers": 2,
        "dim_date": 3,
        "fact_order_items": 7,
    }


def test_shuffle_width_grows_with_the_sources_and_never_shrinks(spark, conf):
    conf(spark__sql__shuffle__partitions="4")
    assert widen_shuffle(spark, {"small": spark.range(10)}) == 4
    assert widen_shuffle(spark, {"unknown": spark.createDataFrame([(1,)], "a int")}) == 4
    assert widen_shuffle(spark, {"big": spark.range(10**11)}) == -(-8 * 10**11 // (128 * 1024 * 1024))
    assert widen_shuffle(spark, {"small": spark.range(10)}) == 5961
    assert widen_shuffle(spark, {"huge": spark.range(10**15)}) == -(-8 * 10**15 // (128 * 1024 * 1024))


def test_csv_export_round_trip(spark, tmp_path, sources):
    dim = build_star(sources).dim_products
    export_csv(dim, f"{tmp_path}/products")
    back = scan_csv(spark, f"{tmp_path}/products", dim.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, dim.collect()))


CONNECTION = {"url": "jdbc:postgresql://db/dwh", "driver": "org.postgresql.Driver", "user": "u", "password": "p"}


def test_jdbc_options():
    options = jdbc_options({**CONNECTION, "batchsize": "5000"}, "dim_date")
    assert options["dbtable"] == "dwh.dim_date" and options["batchsize"] == "5000" and options["numPartitions"] == "16"
    assert jdbc_options(CONNECTION, "dim_date", schema=None)["dbtable"] == "dim_date"
    with pytest.raises(ValueError, match="url"):
        jdbc_options({}, "dim_date")


class Warehouse:
    """What would reach a database is recorded, not run: none is started for a test."""

    def __init__(self):
        self.loads, self.log, self.fails_at = [], [], None

    def setAutoCommit(self, on):  # noqa: N802
        assert on is False

    def createStatement(self):  # noqa: N802
        return self

    def execute(self, statement):
        if self.fails_at and self.fails_at in statement:
            raise RuntimeError("refused")
        self.log.append(statement)

    def commit(self):
        self.log.append("COMMIT")

    def rollback(self):
        self.log.append("ROLLBACK")

    def close(self):
        pass


@pytest.fixture
def recorded(monkeypatch):
    warehouse = Warehouse()

    def save(writer, *args, **kwargs):
        warehouse.loads.append(writer._df.count())

    monkeypatch.setattr(DataFrameWriter, "save", save)
    monkeypatch.setattr(jdbc, "_connect", lambda spark, connection: warehouse)
    monkeypatch.setattr(jdbc, "_rows_in", lambda df, options: df.count())
    return warehouse


def test_jdbc_publish_swaps_staged_tables_in_one_transaction(spark, sources, recorded):
    tables = build_star(sources).tables()
    loaded = jdbc.publish_jdbc(tables, CONNECTION)
    assert recorded.loads == list(loaded.values()) == [2, 2, 2, 3, 7]
    truncate, *inserts = recorded.log[: recorded.log.index("COMMIT")]
    # The order in which the warehouse's tables are emptied.
    assert truncate == (
        "TRUNCATE TABLE dwh.fact_order_items, dwh.dim_date, dwh.dim_sellers, dwh.dim_products, dwh.dim_customers "
        "RESTART IDENTITY CASCADE"
    )
    assert [i.split()[2] for i in inserts] == [f"dwh.{name}" for name in STAR_TABLES]
    assert '"SellerKey") SELECT "seller_id"' in inserts[2] and "FROM dwh.stage_" in inserts[2]
    dropped = recorded.log[recorded.log.index("COMMIT") + 1 :]
    assert len(dropped) == 6 and dropped[-1] == "COMMIT" and all(d.startswith("DROP TABLE IF EXISTS dwh.stage_") for d in dropped[:5])
    with pytest.raises(QualityError):
        jdbc.publish_jdbc(tables, CONNECTION, gate="fail")


def test_a_refused_statement_leaves_the_warehouse_and_no_staging(spark, sources, recorded):
    recorded.fails_at = "INSERT INTO dwh.fact_order_items"
    with pytest.raises(RuntimeError, match="refused"):
        jdbc.publish_jdbc(build_star(sources).tables(), CONNECTION)
    rolled = recorded.log.index("ROLLBACK")
    assert "COMMIT" not in recorded.log[:rolled] and sum(x.startswith("DROP") for x in recorded.log[rolled:]) == 5


def test_jdbc_publish_loads_again_when_rows_were_doubled(spark, sources, recorded, monkeypatch):
    tables = build_star(sources).tables()
    answers = iter([4, 2, 2, 2, 3, 7])
    monkeypatch.setattr(jdbc, "_rows_in", lambda df, options: next(answers))
    assert jdbc.publish_jdbc(tables, CONNECTION)["dim_customers"] == 2
    assert recorded.loads == [2, 2, 2, 2, 3, 7]
    monkeypatch.setattr(jdbc, "_rows_in", lambda df, options: 99)
    recorded.log.clear()
    with pytest.raises(RuntimeError, match="holds 99 rows"):
        jdbc.publish_jdbc(tables, CONNECTION)
    assert not any(x.startswith(("TRUNCATE", "INSERT")) for x in recorded.log)


def test_jdbc_run_passes_written_tables(spark, sources, recorded):
    star = run_star(spark, sources, CONNECTION, publish=True)
    assert recorded.loads == [2, 2, 2, 3, 7]
    assert spark.read.parquet(f"{star.scratch}/fact_order_items").count() == 7


def test_jdbc_counts_in_the_database(spark, monkeypatch):
    asked = {}

    class Reader:
        def options(self, **given):
            asked.update(given)
            return self

        def load(self):
            return spark.createDataFrame([(5,)], "n long")

    monkeypatch.setattr(type(spark.read), "format", lambda self, kind: Reader())
    options = jdbc_options(CONNECTION, "dim_date")
    assert jdbc._rows_in(spark.range(1), options) == 5
    assert asked["dbtable"] == "(SELECT count(*) AS n FROM dwh.dim_date) counted"
    assert options["numPartitions"] == "16"


def test_a_closed_gate_leaves_no_scratch(spark, sources, tmp_path):
    scratch = f"{tmp_path}/starloom/one"
    with pytest.raises(QualityError):
        run_star(spark, sources, gate="fail", scratch=scratch)
    assert not (tmp_path / "starloom" / "one").exists()


def test_scratch_is_unique(spark):
    assert new_scratch(spark) != new_scratch(spark)
