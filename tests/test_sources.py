import base64
import json
import sqlite3
import zlib

import numpy as np
import pytest

from peakforge import cli
from peakforge.sources import loader, sinks
from peakforge.sources.text_formats import read_gnps_json, read_mgf, read_msp

MGF = """BEGIN IONS
PEPMASS=300.5
CHARGE=1+
NAME=a=b
SMILES=CC=O
RTINSECONDS=61.5
100.5 10
99.5\t5.5 
END IONS

BEGIN IONS
PEPMASS=212.1 1000.0
NAME=
END IONS
"""


@pytest.fixture
def mgf(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mgf").write_text(MGF)
    return tmp_path / "in" / "a.mgf"


def test_mgf(spark, mgf):
    rows = loader.load_spectra(spark, str(mgf)).orderBy("record_no").collect()
    assert [r.record_no for r in rows] == [0, 1]
    assert [(p.mz, p.intensity) for p in rows[0].peaks] == [(99.5, 5.5), (100.5, 10.0)] and rows[1].peaks == []
    assert rows[0].compound_name == "a=b" and rows[0].smiles == "CC=O" and rows[0].charge == 1 and rows[0].retention_time == 61.5
    assert [r.precursor_mz for r in rows] == [300.5, 212.1]


def test_many_records_keep_their_order(spark, tmp_path):
    path = tmp_path / "many.mgf"
    path.write_text("".join(f"BEGIN IONS\nSCANS={i}\n1 1\nEND IONS\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert all(int(r.metadata["scans"]) == r.record_no for r in read_mgf(spark, str(path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mgf_round_trip(spark, mgf, tmp_path):
    first = read_mgf(spark, str(mgf))
    sinks.write_mgf(first, str(tmp_path / "out"))
    again = read_mgf(spark, str(tmp_path / "out"))
    key = lambda df: sorted((r.peaks, sorted(r.metadata.items())) for r in df.collect())
    assert key(first) == key(again)


def test_msp(spark, tmp_path):
    path = tmp_path / "a.msp"
    path.write_text("Name: one\nPrecursorMZ: 100.25\nNum Peaks: 2\n10 1; 20 2\n\nName: two\nNum Peaks: 1\n5.5\t9 \"x\"\n\n")
    rows = read_msp(spark, str(path)).orderBy("record_no").collect()
    assert [r.metadata["compound_name"] for r in rows] == ["one", "two"]
    assert [[(p.mz, p.intensity) for p in r.peaks] for r in rows] == [[(10.0, 1.0), (20.0, 2.0)], [(5.5, 9.0)]]


@pytest.mark.parametrize("size", ["4k", "128m"])
def test_msp_with_carriage_returns(spark, tmp_path, size):
    """CR LF, records without an empty line between, ``;`` in metadata; records over file blocks keep their order."""
    text = "".join(f"Name: n{i}\r\nComment: a;1 b; 2\r\nNum Peaks: 2\r\n10 {i}; 20 2\r\n" + ("\r\n" if i % 2 else "") for i in range(300))
    (tmp_path / "a.msp").write_bytes(text.encode())
    (tmp_path / "b.msp").write_text("\n\nNAME: x\n1 1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = read_msp(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r.record_no, r.metadata["compound_name"], r.metadata["comment"], [tuple(p) for p in r.peaks]) for r in rows if r.source_file.endswith("a.msp"))
    assert a == [(i, f"n{i}", "a;1 b; 2", [(10.0, float(i)), (20.0, 2.0)]) for i in range(300)]
    assert [(r.record_no, r.metadata["compound_name"]) for r in rows if r.source_file.endswith("b.msp")] == [(0, "x")]


def test_msp_over_parts_of_lines(spark, tmp_path, monkeypatch):
    from peakforge.sources import text_formats

    monkeypatch.setattr(text_formats, "PART_LINES", 5)
    (tmp_path / "a.msp").write_text("".join(f"Comment: first\nName: n{i}\n" + "".join(f"{j} 1\n" for j in range(1, i % 7 + 2)) + "\n" * (1 + i % 3) for i in range(60)))
    rows = sorted((r.record_no, r.metadata.get("compound_name"), len(r.peaks)) for r in read_msp(spark, str(tmp_path / "a.msp")).collect())
    assert [n for _, n, _ in rows if n] == [f"n{i}" for i in range(60)] and [k for _, n, k in rows if n] == [i % 7 + 1 for i in range(60)]


def test_large_json_is_cut_into_records(spark, tmp_path):
    records = [{"spectrum_id": f"S{i}", "peaks_json": f"[[{i + 1}, 1], [1, 3]]", "note": 'a "quoted" brace { and ] [', "more": {"x": i}} for i in range(400)]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "b.json").write_text("[]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = sorted(read_gnps_json(spark, str(tmp_path)).collect(), key=lambda r: r.record_no)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.record_no, r.metadata["spectrum_id"], r.metadata["note"], len(r.peaks)) for r in rows] == [(i, f"S{i}", records[i]["note"], 2) for i in range(400)]
    (tmp_path / "c.json").write_text('[{"a": "x"}, {"b": "broken')
    with pytest.raises(Exception):  # noqa: B017
        read_gnps_json(spark, str(tmp_path / "c.json")).collect()


def test_gnps_json(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"Precursor_MZ": 5.5, "peaks_json": "[[2, 1], [1, 3]]"}, {"inchi_key": "K"}]))
    rows = read_gnps_json(spark, str(path)).orderBy("record_no").collect()
    assert [(p.mz, p.intensity) for p in rows[0].peaks] == [(1.0, 3.0), (2.0, 1.0)] and rows[0].metadata["precursor_mz"] == "5.5"
    assert rows[1].peaks == [] and rows[1].metadata["inchikey"] == "K"


def packed(values, kind, compress):
    raw = np.array(values, kind).tobytes()
    return base64.b64encode(zlib.compress(raw) if compress else raw).decode()


def test_mzml(spark, tmp_path):
    cv = lambda a, v="": f'<cvParam accession="{a}" name="n" value="{v}"/>'
    arrays = f"""<binaryDataArrayList count="2"><binaryDataArray>{cv("MS:1000523")}{cv("MS:1000574")}{cv("MS:1000514")}<binary>{packed([20, 10], "<f8", True)}</binary></binaryDataArray>
    <binaryDataArray>{cv("MS:1000521")}{cv("MS:1000576")}{cv("MS:1000515")}<binary>{packed([1, 2], "<f4", False)}</binary></binaryDataArray></binaryDataArrayList>"""
    ion = f"<precursorList count='1'><precursor><selectedIonList count='1'><selectedIon>{cv('MS:1000744', '321.5')}</selectedIon></selectedIonList></precursor></precursorList>"
    (tmp_path / "a.mzML").write_text(f"<mzML><run><spectrumList><spectrum index='0' id='s0'>{cv('MS:1000511', '1')}</spectrum><spectrum index='1' id='s1'>{cv('MS:1000511', '2')}{cv('MS:1000130')}{ion}{arrays}</spectrum></spectrumList></run></mzML>")
    rows = loader.load_spectra(spark, str(tmp_path / "a.mzML")).collect()
    assert len(rows) == 1 and rows[0].precursor_mz == 321.5 and rows[0].ionmode == "positive"
    assert [(p.mz, p.intensity) for p in rows[0].peaks] == [(10.0, 2.0), (20.0, 1.0)]


def test_mzxml(spark, tmp_path):
    data = packed([20, 1, 10, 2], ">f4", False)
    (tmp_path / "a.mzXML").write_text(f'<mzXML><msRun><scan num="7" msLevel="2" polarity="-" retentionTime="PT12.5S"><precursorMz precursorIntensity="1.0">99.5</precursorMz><peaks precision="32" byteOrder="network">{data}</peaks></scan></msRun></mzXML>')
    r = loader.load_spectra(spark, str(tmp_path / "a.mzXML")).first()
    assert (r.precursor_mz, r.ionmode, r.retention_time) == (99.5, "negative", 12.5)
    assert [(p.mz, p.intensity) for p in r.peaks] == [(10.0, 2.0), (20.0, 1.0)]


def test_folder_and_unknown_files(spark, mgf):
    (mgf.parent / "notes.txt").write_text("x")
    (mgf.parent / "sub").mkdir()
    said = []
    assert loader.load_folder(spark, str(mgf.parent), said.append).count() == 2 and "notes.txt" in said[0]
    assert loader.load_folder(spark, str(mgf.parent / "sub"), said.append) is None
    with pytest.raises(ValueError):
        loader.load_spectra(spark, "x.pickle")
    with pytest.raises(NotImplementedError):
        loader.load_spectra(spark, "x.usi")


def test_library_files():
    found = loader.find_library_files(["l.sqlite", "m.onnx", "a_s2v_embeddings.parquet", "a_ms2ds_embeddings.parquet", "other"])
    assert found.sqlite == "l.sqlite" and found.embeddings == "a_ms2ds_embeddings.parquet" and found.network is None
    for names, error in ((["a.onnx", "b.onnx"], ValueError), (["a.pickle"], ValueError), (["a.sqlite"], FileNotFoundError)):
        with pytest.raises(error):
            loader.find_library_files(names)


def test_import_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "l.sqlite") as db:
        db.execute("create table spectrum_data (spectrumid integer primary key, metadata text, precursor_mz real)")
        db.execute("create table inchikeys (inchikey text, spectrum_ids_belonging_to_inchikey14 text, closest_related_inchikeys text, cf_kingdom text)")
        db.execute("insert into spectrum_data values (0, ?, 5.5)", (str({"inchikey": "ABCDEFGHIJKLMN-X", "charge": 1}),))
        db.execute("insert into inchikeys values ('ABCDEFGHIJKLMN', '[0]', ?, 'k')", (str([("ABCDEFGHIJKLMN", 1.0)]),))
    spectra, structures = loader.import_sqlite(spark, str(tmp_path / "l.sqlite"))
    assert spectra.first().inchikey14 == "ABCDEFGHIJKLMN" and spectra.first().charge == 1
    assert structures.first().neighbours[0].tanimoto == 1.0 and structures.first().cf_kingdom == "k"


def test_wide_embeddings(spark, tmp_path):
    spark.createDataFrame([(4, 1.0, 2.0)], "spectrum_id long, `0` double, `1` double").write.parquet(str(tmp_path / "e"))
    r = loader.read_embeddings(spark, str(tmp_path / "e")).first()
    assert r.spectrum_id == 4 and list(r.embedding) == [1.0, 2.0]


def test_sinks(spark, tmp_path):
    path = tmp_path / "x.csv"
    assert sinks.free_name(str(path)) == str(path)
    path.write_text("")
    assert sinks.free_name(str(path)).endswith("x(1).csv")
    df = spark.createDataFrame([(2, 1, 0.123456, None), (1, 1, 1.0, "a,b")], "query_spectrum_nr long, rank long, s double, name string")
    sinks.write_results(df, str(tmp_path / "r"), single=True)
    lines = [p for p in (tmp_path / "r").iterdir() if p.suffix == ".csv"][0].read_text().splitlines()
    assert lines == ["query_spectrum_nr,s,name", '1,1.0000,"a,b"', "2,0.1235,"]
    sinks.write_json({"a": 1}, str(tmp_path / "j.json"))
    with pytest.raises(FileExistsError):
        sinks.write_json({}, str(tmp_path / "j.json"))


def test_command_line(spark, mgf, tmp_path):
    from pyspark.sql import functions as F

    from peakforge.operators.library import Library

    spectra = spark.createDataFrame([(i, 300.0 + i, "positive", f"K{i}") for i in range(4)], "spectrum_id long, precursor_mz double, ionmode string, inchikey14 string")
    emb = spectra.select("spectrum_id", F.array(F.col("spectrum_id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    Library.build(spectra, spectra.select("inchikey14", F.col("spectrum_id").alias("bit")), emb, emb, n=1).save(f"{tmp_path}/lib")
    (mgf.parent / "a.mgf").write_text("BEGIN IONS\nPEPMASS=300\nIONMODE=Positive\n1 1\n2 2\n3 3\nEND IONS\n")
    spark.createDataFrame([(0, [2.0, 1.0], [2.0, 1.0])], "query_id long, embedding array<float>, second_embedding array<float>").write.parquet(f"{tmp_path}/lib/query_embeddings")
    args = ["--spectra", str(mgf), "--library", f"{tmp_path}/lib", "--ionmode", "positive", "--results", str(tmp_path / "res")]
    out = cli.run(spark, args)
    assert spark.read.csv(out, header=True).first().query_spectrum_nr == "1"
    assert cli.run(spark, args) != out
    assert cli.run(spark, ["--library", f"{tmp_path}/lib"]) is None
    with pytest.raises(ValueError):
        cli.run(spark, [*args[:4], "--ionmode", "negative"])
    # A folder: one result for each spectrum file, numbered from 1 in each.
    one = "BEGIN IONS\nPEPMASS=300\nIONMODE=Positive\n1 1\n2 2\n3 3\nEND IONS\n"
    (mgf.parent / "b.mgf").write_text("BEGIN IONS\nPEPMASS=300\n1 1\nEND IONS\n" + one)
    (mgf.parent / "notes.txt").write_text("x")
    vectors = [(i, [2.0, 1.0], [2.0, 1.0]) for i in range(3)]
    spark.createDataFrame(vectors, "query_id long, embedding array<float>, second_embedding array<float>").write.parquet(f"{tmp_path}/vectors")
    found = cli.run(spark, ["--spectra", str(mgf.parent), "--library", f"{tmp_path}/lib", "--embeddings", f"{tmp_path}/vectors", "--results", str(tmp_path / "all")])
    assert sorted(p.name for p in (tmp_path / "all").iterdir()) == ["a.csv", "b.csv"]
    assert [[r.query_spectrum_nr for r in spark.read.csv(f"{found}/{n}.csv", header=True).collect()] for n in "ab"] == [["1"], ["2"]]
    words = spark.createDataFrame([(f"peak@{m}.00", [float(m), 1.0]) for m in (1, 2, 3)], "word string, vector array<double>")
    words.write.parquet(f"{tmp_path}/words")
    more = cli.run(spark, [*args, "--word_vectors", f"{tmp_path}/words"])
    assert spark.read.csv(more, header=True).count() == 1
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--spectra", "/nowhere"])
