"""Archives as a data source."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from fathomline.sources import archive, datasource

N = 60


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    datasource.register(spark)
    root = tmp_path_factory.mktemp("archives")
    for v in ("8.3.24", "8_3_26"):
        (root / v).mkdir()
        for name in ("a_ru.hbk", "b_ru.res", "c_en.hbk"):
            body, toc = io.BytesIO(), io.BytesIO()
            with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
                for i in range(N):
                    z.writestr(f"objects/o{i % 3}/methods/m{i}.html", f"<h1>{v}{name}{i}</h1>Описание: {'текст ' * i}".encode("cp1251" if i % 2 else "utf-8"))
                z.writestr("misc/x.html", "Описание")
            with zipfile.ZipFile(toc, "w") as z:
                z.writestr("toc", "{1,0,1,2}{2,1,0}")
            (root / v / name).write_bytes(archive.container({"FileStorage": body.getvalue(), "PackBlock": toc.getvalue()}))
    (root / "8.3.24" / "broken_ru.hbk").write_bytes((root / "8.3.24" / "a_ru.hbk").read_bytes()[:300])
    (root / "8.3.24" / "short_ru.hbk").write_bytes(b"x")
    (root / "8.3.24" / "zeros_ru.hbk").write_bytes(b"\0" * 5000)
    return root


def read(spark, root, **options):
    d = spark.read.format("help_archive").option("path", str(root))
    for k, v in options.items():
        d = d.option(k, v)
    return d.load()


def key(d):
    return sorted((r["archive"].rsplit("/", 1)[1], r["version"], r["path"], r["html"], r["size"]) for r in d.collect())


@pytest.mark.parametrize("step", [1500, 8 << 20])
def test_ranges_of_any_size_give_each_page_once(spark, folder, step):
    d = read(spark, folder, rangeBytes=step)
    other = archive.read_pages(spark, str(folder))
    assert sorted((r["path"], r["html"]) for r in d.collect()) == sorted((r["path"], r["html"]) for r in other.collect())
    assert d.count() == 4 * N
    r = datasource.ArchiveReader({"path": str(folder), "rangeBytes": str(step)})
    assert (len(r.partitions()) > 8) == (step < 2000)


def test_conditions_reach_files_and_entries(spark, folder):
    d = read(spark, folder).filter((F.col("version") == "8.3.26") & F.col("path").startswith("objects/o1/") & F.col("html").contains("a_ru"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    # What the source takes over is left to no filter behind the scan.
    assert "BatchScan help_archive" in plan and "a_ru" in plan and "8.3.26" not in plan and "objects/o1/" not in plan
    assert {(r["version"], r["path"].split("/")[1]) for r in d.collect()} == {("8.3.26", "o1")} and d.count() == N // 3
    r = datasource.ArchiveReader({"path": str(folder)})
    keep = list(r.pushFilters([datasource.EqualTo(("version",), "8.3.26"), datasource.EqualTo(("path",), "objects/o1/methods/m1.html"), datasource.EqualTo(("size",), 1)]))
    assert [f.attribute for f in keep] == [("size",)]
    assert {p[0].split("/")[-2] for part in r.partitions() for p in part.parts} == {"8_3_26"}
    assert read(spark, folder).filter("version in ('8.3.24', 'x') and path like '%m7.html'").count() == 2
    assert read(spark, folder).filter("version = '1.1.1'").count() == 0
    assert read(spark, folder).filter("archive like '%a_ru.hbk' or size < 0").count() == 2 * N  # not pushed, still right


def test_options(spark, folder):
    assert read(spark, folder, glob="*_en.hbk").count() == 2 * N
    assert read(spark, folder, onlyHelp="false").count() == 4 * (N + 1)
    toc = read(spark, folder, what="contents")
    assert sorted(tuple(r)[1:] for r in toc.filter("version = '8.3.26'").collect()) == sorted([(1, 0, 1, [2], "8.3.26"), (2, 1, 0, [], "8.3.26")] * 2)


def rows(spark, n=50):
    return spark.createDataFrame([(f"8.3.{i % 3}/x{i % 2}_ru.hbk", f"p{i}.html", f"текст {i}" if i else None, 7) for i in range(n)], "archive string, path string, html string, extra int")


def test_writing_and_reading_back(spark, tmp_path):
    datasource.register(spark)
    put = lambda d, mode="append": d.repartition(3, "archive").sortWithinPartitions("archive").write.format("help_archive").mode(mode).save(str(tmp_path / "w"))
    put(rows(spark))
    d = read(spark, tmp_path / "w", onlyHelp="false")
    assert {(r["path"], r["html"], r["version"]) for r in d.collect()} == {(f"p{i}.html", f"текст {i}" if i else "", f"8.3.{i % 3}") for i in range(50)}
    assert not list((tmp_path / "w").rglob(".*.part"))
    put(rows(spark, 4), "overwrite")
    assert read(spark, tmp_path / "w", onlyHelp="false").count() == 4  # files are listed when a read is planned
    with pytest.raises(Exception, match="stand together"):
        rows(spark).coalesce(1).write.format("help_archive").mode("append").save(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="several tasks"):
        rows(spark).filter("archive = '8.3.0/x0_ru.hbk'").repartition(3).write.format("help_archive").mode("append").save(str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="is missing"):
        rows(spark).drop("html").write.format("help_archive").mode("append").save(str(tmp_path / "bad"))
