import json

from pyspark.sql import functions as F

from marula.functions import text as T
from marula.sources import files
from marula.streaming.windows import windowed_counts


def test_exports_in_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Title,Year\n"Line one\nline ""two""",2015\nNA,\n'.encode())
    (tmp_path / "b.csv").write_bytes("Title,Year,Extra\ncaf\xe9,2016,x\n".encode("latin-1"))
    rows = {(r.Title, r.Year, r.Extra, r.source_file) for r in files.read_exports(spark, str(tmp_path)).collect()}
    assert rows == {('Line one\nline "two"', "2015", None, "a.csv"), ("NA", None, None, "a.csv"), ("café", "2016", "x", "b.csv")}


def test_resolve_column():
    assert files.resolve_column(["Title ", "DOI"], "doi") == "DOI"
    assert files.resolve_column(["Title "], "title") == "Title "
    assert files.resolve_column([], "x") is None


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\td'), (2, "é|x"), (3, None)], "id bigint, v string")
    for kind in ("csv", "tsv", "json", "parquet"):
        path = str(tmp_path / kind)
        for _ in range(2):
            files.write_table(df, path, kind, one_file=True)
        if kind in ("csv", "tsv"):
            back = spark.read.option("header", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path).select(F.col("id").cast("bigint"), "v")
        else:
            back = spark.read.format(kind).load(path).select("id", "v")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_registry(spark, tmp_path):
    data = [
        {"id": "1", "names": [{"value": "Short", "types": ["acronym"]}, {"value": "Shown", "types": ["label", "ror_display"]}], "locations": [{"geonames_details": {"country_code": "KE"}}, {"geonames_details": {"country_code": "UG"}}]},
        {"id": "2", "names": [{"value": "Only", "types": ["label"]}], "locations": []},
    ]
    (tmp_path / "r.json").write_text(json.dumps(data))
    got = {(r.id, r.display, r.country_code) for r in files.read_registry(spark, str(tmp_path / "r.json")).collect()}
    assert got == {("1", "Shown", "KE"), ("1", "Shown", "UG"), ("2", "Only", None)}


def test_xml_lines(spark, tmp_path):
    (tmp_path / "q.xml").write_text('<?xml version="1.0"?><a:q xmlns:a="http://x"><a:query-lines><a:query-line field="K"> one\n two </a:query-line><a:query-line field="Z">no</a:query-line><a:query-line field="K">three</a:query-line></a:query-lines></a:q>')
    got = [(r.pos, r.line) for r in files.read_query_lines(spark, str(tmp_path / "q.xml"), "a:query-line", "K").orderBy("pos").collect()]
    assert got == [(1, "one two"), (2, "three")]


def test_text_pairs_and_digests(spark, tmp_path):
    (tmp_path / "x.txt").write_text("key: a: b\nnothing\n")
    assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / "x.txt")).collect()] == [("key", "a: b")]
    assert files.read_text(spark, str(tmp_path / "x.txt")).first().text.startswith("key")
    assert len(files.file_digests(spark, str(tmp_path)).first().digest) == 64


def test_markdown(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, v string")
    assert files.markdown_table(df) == "| n | v |\n|---|---|\n| 1 | a\\|b |\n| 2 |  |"


def test_text_functions(spark):
    rows = [("https://doi.org/10.1/X",), (" doi: 10.2/y ",), ("N/A",), ("#NAME?",), ("dx.doi.org/10.3",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(T.normal_doi(F.col("v"))).collect()]
    assert got == ["10.1/x", "10.2/y", None, None, "dx.doi.org/10.3", None, None]
    names = [("Université du North-West, Inc.",), ("The  Bank of X",)]
    got = [r[0] for r in spark.createDataFrame(names, "v string").select(T.exact_name(F.col("v"))).collect()]
    assert got == ["université north west inc", "the bank of x"]
    got = [r[0] for r in spark.createDataFrame([("one two three",), ("abcdefghijkl",), ("ab",)], "v string").select(T.cut_words(F.col("v"), 8)).collect()]
    assert got == ["one two", "abcdefgh", "ab"]
    got = [r[0] for r in spark.createDataFrame([("2015.0",), ("x",), ("2016",)], "v string").select(T.whole_number(F.col("v"))).collect()]
    assert got == [2015, None, 2016]


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    batch = {tuple(r) for r in windowed_counts(events).select("window_start", "event_type", "n").collect()}
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    q = windowed_counts(spark.readStream.schema(events.schema).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("counts").select("window_start", "event_type", "n").collect()}
    assert got == batch


def test_exports_by_name_and_marks(spark, tmp_path):
    (tmp_path / "SDG01_x.csv").write_text("Title,Year\nNA,1\nb,\n")
    (tmp_path / "other.csv").write_text("Title,Year\nz,9\n")
    got = files.read_exports(spark, str(tmp_path), name_like=r"SDG\d+_.*\.csv", missing=["NA"]).collect()
    assert sorted((r.Title or "", r.Year) for r in got) == [("", "1"), ("b", None)]
    assert files.read_exports(spark, str(tmp_path), name_like="nothing").count() == 0
    (tmp_path / "big name é.csv").write_bytes(b"Title\n" + b"x" * (files.CHUNK - 1) + "é\n".encode())
    assert [r.Title[-1] for r in files.read_exports(spark, str(tmp_path), name_like="big.*").collect()] == ["é"]


def test_typed_bom_and_checksums(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("1\ta\t0.5\n2\tb\t1.5\n")
    df = files.read_typed(spark, str(tmp_path / "n.tsv"), "id bigint, label string, x double")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a", 0.5), (2, "b", 1.5)]
    files.write_table(df, str(tmp_path / "out"), one_file=True, bom=True)
    written = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert written.startswith("﻿id,label,x".encode())
    import hashlib

    (tmp_path / "c").mkdir()
    for name in ("b.bin", "a.bin"):
        (tmp_path / "c" / name).write_bytes(name.encode() * 1000)
    text = files.checksum_list(files.file_digests(spark, str(tmp_path / "c")))
    assert text == "".join(f"{hashlib.sha256(n.encode() * 1000).hexdigest()}  {n}\n" for n in ("a.bin", "b.bin"))


def test_register(spark, tmp_path):
    from marula.operators import register as R

    name = lambda v, *t: {"value": v, "types": list(t)}
    place = lambda c: {"geonames_details": {"country_code": c}}
    data = [
        {"id": "1", "names": [name("UCC", "acronym"), name("University of the Cape", "ror_display")], "locations": [place("GH"), place("GH"), place("UG")]},
        {"id": "2", "names": [name("University  Cape", "label"), name("UCC", "acronym")], "locations": [place("GH")]},
        {"id": "3", "names": [name("Far", "label")], "locations": [place("FR")]},
    ]
    (tmp_path / "r.json").write_text(json.dumps(data))
    r = files.read_register(spark, str(tmp_path / "r.json"))
    assert {x.id for x in R.in_countries(r, ["GH", "UG"]).collect()} == {"1", "2"}
    assert [tuple(x) for x in R.country_counts(r, ["UG", "GH", "TG"]).collect()] == [("GH", 2), ("UG", 1), ("TG", 0)]
    assert {tuple(x) for x in R.exact_lookup(r).collect()} == {("university cape", "1"), ("far", "3")}
    assert {tuple(x) for x in R.acronym_lookup(r).collect()} == {("GH", "UCC", "2"), ("UG", "UCC", "1")}
    assert {(x.id, x.display) for x in R.metadata(r).collect()} == {("1", "University of the Cape"), ("2", "University  Cape"), ("3", "Far")}


def test_provenance(spark, tmp_path):
    from marula.sources import provenance as P

    (tmp_path / "c.yaml").write_text("cleaning:\n  dedup_title_threshold: 0.97\n  dedup_year_window: 2\ncorpus:\n  doc_types: [ar]\nother: 1\n")
    assert P.read_config(tmp_path / "c.yaml") == P.Config(title_threshold=97.0, year_window=2, doc_types=("ar",))
    (tmp_path / "empty.yaml").write_text("")
    assert P.read_config(tmp_path / "empty.yaml") == P.Config()
    assert P.read_requirements("# x\npandas>=2.0  # y\n-r more\n\nnumpy\nfoo[bar]==1.2; python_version > '3'\n") == [("pandas", ">=", "2.0"), ("numpy", "", ""), ("foo[bar]", "==", "1.2")]
    assert P.command_output(["no-such-program"]) == "not available" and P.command_output(["echo", "hi"]) == "hi"
    rows = {r.name: r.version for r in P.session_manifest(spark, ["numpy", "nothing-here"]).collect()}
    assert rows["spark"] == spark.version and rows["nothing-here"] == "not installed" and rows["java"]
    log = P.stage_logger("t", tmp_path / "logs" / "t.log")
    assert P.stage_logger("t", tmp_path / "logs" / "t.log") is log and len(log.handlers) == 2
    log.info("done")
    assert "done" in (tmp_path / "logs" / "t.log").read_text()
    f, kept = tmp_path / "q.txt", tmp_path / "archive" / "q.txt"
    f.write_text("first")
    assert P.archive_or_restore(f, kept) == "first"
    f.write_text("changed")
    assert P.archive_or_restore(f, kept) == "first" == f.read_text()
    assert P.expected_files([P.query_file(1), P.query_file(2, 2015, 2018)], tmp_path) == [("SDG01_full.txt", False), ("SDG02_full_2015-2018.txt", False)]
    text = P.report("Run", [("Counts", spark.createDataFrame([(1, "x")], "n int, v string")), ("Note", "All well.")])
    assert text.startswith("# Run\n\n## Counts\n\n| n | v |") and text.endswith("All well.\n")


def test_query_terms_in_and_out_of_the_jvm(spark):
    from marula.operators import boolquery as Q
    from marula.plans.querytext import query_terms

    lines = ['( "Food Secur*" OR farm* OR Maize AND "ab" )', '"co-op"/rice,[tea] W/3 ("x  y**" NOT near)', "", "été OR ab12 OR abc"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r[0] for r in df.select(query_terms(df.line)).collect()] == [Q.vocabulary(x) for x in lines]
    assert Q.vocabulary('{one two three four} OR "a*"') == ["two", "three"]


def test_cleaning_totals_of_composed_queries():
    from marula.operators import boolquery as Q

    text = Q.compose(['"child*" OR "food secur*" OR {exact phrase*}', '"develop* countr*" OR micro-financ*', '( wast* ) W/3 ( "x" ) OR ( *word )'], ["Togo"])
    cleaned, counts = Q.clean(text)
    assert dict(counts) == {"A": 1, "B": 1, "C": 1, "D": 1, "E": 1, "F": 1, "G": 1}
    assert Q.clean(cleaned) == (cleaned, {})
