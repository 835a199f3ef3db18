import json

import pytest
from pyspark.sql import functions as F

from peergraph.sources import filings, universe

SERVICE = "tests.filing_service:service"


def row(cik, n, form="10-K", date=None):
    year = 2022 + n
    return {"cik": cik, "accession": f"{cik}-{n}", "form": form, "year": year, "filing_date": date or f"{year}-03-0{cik}", "period": f"{year - 1}-12-31", "section": "business", "status": "fetched", "text_raw": f"text {cik} {n}"}


ROWS = [row(c, n) for c in (1, 2, 4) for n in (0, 1, 2)] + [row(1, 1, "8-K"), row(2, 2, "8-K")]


@pytest.fixture
def known(tmp_path, monkeypatch, spark):
    """A folder that running Python workers learn of by a fixed link, as their environment is set already."""
    import os
    import tempfile

    link = os.path.join(tempfile.gettempdir(), f"filing-service-{os.getpid()}")
    if os.path.islink(link):
        os.unlink(link)
    os.symlink(tmp_path, link)
    monkeypatch.setenv("FILING_SERVICE", link)
    spark.sparkContext.environment["FILING_SERVICE"] = link

    def tell(rows, through):
        (tmp_path / "known.json").write_text(json.dumps({"rows": rows, "through": through}))

    tell(ROWS, "2024-12-31")
    tell.asked = lambda: [json.loads(x) for x in (tmp_path / "asked.jsonl").read_text().splitlines()] if (tmp_path / "asked.jsonl").exists() else []
    yield tell
    os.unlink(link)


def read(spark, ciks="1,2,3,4,5", **options):
    filings.register(spark)
    return spark.read.format("filings").options(service=SERVICE, ciks=ciks, **options).load()


def test_the_source_gives_what_ingest_gives(spark, known):
    df = filings.read(spark, SERVICE, spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 5, 1, None)], "cik long"), batch=2)
    assert df.rdd.getNumPartitions() == 3
    got = {(r.cik, r.accession, r.form, r.status, r.error) for r in df.collect()}
    rows = [{**{c: None for c in filings.COLUMNS}, **r} for r in ROWS]

    def fetch(cik):
        if cik == 3:
            raise RuntimeError("down")
        return [r for r in rows if r["cik"] == cik]

    empty = spark.createDataFrame([], filings.SCHEMA)
    every, kept = universe.ingest(spark.createDataFrame([(c,) for c in range(1, 6)], "cik long"), empty, fetch, ["business"])
    assert got == {(r.cik, r.accession, r.form, r.status, r.error) for r in every.collect()} and (3, None, None, "error", "down") in got
    assert kept.count() == len(ROWS) and [c for c in known.asked() if c[0] == 5] == [[5, None, None]]  # a filer without filings was asked once


def test_filters_reach_the_service(spark, known):
    df = read(spark).where("cik in (1, 2) and year >= 2023 and year < 2025 and form = '10-K'")
    assert sorted((r.cik, r.year) for r in df.collect()) == [(1, 2023), (1, 2024), (2, 2023), (2, 2024)]
    assert sorted(known.asked()) == [[1, [2023, 2024], ["10-K"]], [2, [2023, 2024], ["10-K"]]]
    assert read(spark).where("year in (2022, 2030) and length(text_raw) > 3").count() == 3 and known.asked()[-1][1] == [2022, 2030]
    assert read(spark).where("cik = 9").count() == 0 and read(spark, ciks="").count() == 0
    assert read(spark).where(F.col("status") == "error").select("cik", "error").collect() == [(3, "down")]
    assert read(spark).where("year > 2023 or form = '8-K'").count() == 3 + 2  # what cannot be handed over Spark does itself


def test_a_stream_gives_each_filing_once(spark, known, tmp_path):
    filings.register(spark)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run(ciks="1,2,4", **options):
        stream = spark.readStream.format("filings").options(service=SERVICE, ciks=ciks, batch=1, **options).load()
        query = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.cik, r.accession, r.form) for r in spark.read.parquet(out).collect())

    known(ROWS, "2023-12-31")
    first = run()
    assert first == sorted((r["cik"], r["accession"], r["form"]) for r in ROWS if r["filing_date"] <= "2023-12-31")
    late = row(4, 2, "10-K/A", "2024-06-01")
    known([*ROWS, late], "2024-12-31")
    second = run()
    assert second == sorted((r["cik"], r["accession"], r["form"]) for r in [*ROWS, late])  # what ingest would give, nothing twice
    assert run() == second  # nothing new, nothing sent
    known([*ROWS, late], "2025-12-31")
    with pytest.raises(Exception, match="down"):
        run(ciks="1,3")
    assert (3, None, None) in run(ciks="1,3", failures="rows")


def test_options_are_checked(spark):
    with pytest.raises(ValueError, match="service"):
        filings.Options.of({}, False)
    with pytest.raises(ValueError, match="failures"):
        filings.Options.of({"service": "a:b", "failures": "maybe"}, False)
    own = filings.Options.of({"service": "a:b", "ciks": "3, 1,1,", "batch": "1"}, True)
    assert [b.ciks for b in own.batches()] == [[1], [3]] and not own.rows_of_failures
