"""Files in, files out: what must stay as it was, what is filled, what is told of damaged files."""

import io
import zipfile

from palimpsest.operators import files
from palimpsest.plans.documents import extracting
from palimpsest.sources import docx, requests, sinks
from pyspark.sql import functions as F

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
HEAD = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14"><w:body>'


def zipped(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(f"word/{name}.xml", text)
    return out.getvalue()


def test_unchanged_bytes_stay():
    body = '<w:p w14:paraId="1"><w:r><w:rPr><w:b/></w:rPr><w:t>Dear\n  </w:t><w:tab/><w:t>Ann é</w:t><w:br/></w:r><w:r/><w:r><w:t>&amp; {{X}}</w:t></w:r></w:p><w:p><w:r><w:t>other</w:t></w:r></w:p>'
    content = zipped(document=HEAD + body + "</w:body></w:document>", extra="<a/>")
    d = docx.Document(content)
    assert d.paragraphs == [("body", 0, 0, ["Dear\n  \tAnn é\n", "", "& {{X}}"]), ("body", 0, 1, ["other"])]
    same = docx.Document(d.written([p[3] for p in d.paragraphs]))
    assert same.paragraphs == d.paragraphs
    new = zipfile.ZipFile(io.BytesIO(d.written([["Dear\n  \tAnn é\n", "", "& <1>\t2"], ["other"]]))).read("word/document.xml").decode()
    assert new == HEAD + body.replace("<w:t>&amp; {{X}}</w:t>", '<w:t xml:space="preserve">&amp; &lt;1&gt;</w:t><w:tab/><w:t xml:space="preserve">2</w:t>') + "</w:body></w:document>"


def test_nested_and_other_prefixes():
    inner = "<x:tbl><x:tr><x:tc><x:p><x:r><x:t>deep</x:t></x:r></x:p></x:tc></x:tr></x:tbl>"
    content = zipped(document=f'<x:document xmlns:x="{W}"><x:body><x:tbl><x:tr><x:tc><x:p><x:r><x:t>cell</x:t></x:r></x:p>{inner}</x:tc></x:tr></x:tbl><x:p><x:hyperlink><x:r><x:t>link</x:t></x:r></x:hyperlink></x:p></x:body></x:document>')
    d = docx.Document(content)
    assert [p[3] for p in d.paragraphs] == [["link"], ["cell"]]
    assert [p[3] for p in docx.Document(d.written([["LINK"], ["CELL"]])).paragraphs] == [["LINK"], ["CELL"]]


def test_rebuild_and_fill(spark):
    content = docx.made([["Hello ", "{{NAME}}"], ["on 5 May 2024"], ["{{NA", "ME}} and {{RISK_ONE}}"]], [["c1 5 May", "c2"], ["d1 {{RISK_TWO}}", "d2"]], "Top {{NAME}}")
    own = spark.createDataFrame([(1, content), (2, b"broken"), (3, None)], "doc_id long, content binary")
    put = spark.createDataFrame([(1, 0, "5 May 2024", "{{DATE}}"), (1, 1, "5 May", "{{D}}"), (1, 2, "zzz", "{{Z}}")], "doc_id long, ord int, original string, placeholder string")
    got = {r.doc_id: r for r in files.rebuild_files(own, put).collect()}
    texts = ["".join(p[3]) for p in docx.Document(got[1].content).paragraphs]
    assert texts == ["Hello {{NAME}}", "on {{DATE}}", "{{NAME}} and {{RISK_ONE}}", "c1 {{D}}", "c2", "d1 {{RISK_TWO}}", "d2", "Top {{NAME}}"]
    assert (got[1].applied, got[1].failed, got[1].success) == (2, ["zzz"], True)
    assert not got[2].success and got[2].content is None and got[3].error

    mapping = spark.createDataFrame([("NAME", "Ann"), ("RISK_ONE", "one {{NAME}}"), (None, "x")], "name string, content string")
    r = files.fill_files(own, mapping).filter("doc_id = 1").first()
    assert ["".join(p[3]) for p in docx.Document(r.content).paragraphs][2:] == ["Ann and one {{NAME}}", "c1 5 May", "c2", "d1 {{RISK_TWO}}", "d2", "Top Ann"]
    assert (r.found, r.filled, r.unfilled) == (3, 2, ["RISK_TWO"])

    sources = spark.createDataFrame([(0, "RISK", "text", True, None), (1, "NAME", None, False, "no file")], "ord int, name string, text string, success boolean, error string")
    r = files.smart_fill(own, sources, "{placeholder_name}\n{source_text}", extracting).filter("doc_id = 1").first()
    assert r.details == {"RISK_ONE": "RISK_ONE: text", "RISK_TWO": "RISK_TWO: text"} and r.unfilled == ["NAME"] and r.errors == ["not read: NAME: no file"]
    assert ["".join(p[3]) for p in docx.Document(r.content).paragraphs][-1] == "Top {{NAME}}"


def test_contexts_of_files(spark):
    content = docx.made([["before"], ["{{B}} {{A}}"]], [["left", "{{A}} {{C}}"]])
    got = {r.placeholder_name: r for r in files.file_contexts(spark.createDataFrame([(1, content)], "doc_id long, content binary")).collect()}
    assert (got["A"].before_text, got["C"].before_text, got["C"].section_heading) == ("before", "left", "Document Start")
    assert got["B"].place < got["A"].place < got["C"].place


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a.docx", b"1"), ("b.docx", None)], "name string, content binary")
    got = {r.name: r for r in sinks.save_files(rows, str(tmp_path / "out")).collect()}
    assert (tmp_path / "out" / "a.docx").read_bytes() == b"1" and got["b.docx"].error and got["b.docx"].path is None
    (tmp_path / "file").write_text("")
    got = sinks.save_files(rows.limit(1), str(tmp_path / "file" / "below"), str(tmp_path / "out2")).first()
    assert got.path == str(tmp_path / "out2" / "a.docx") and got.warning and got.error is None
    assert spark.range(1).select(sinks.safe_name(F.lit("..\\x/../a b*.docx")).alias("n")).first().n == "a_b_.docx"


def test_requests(spark):
    assert [tuple(r) for r in requests.mapping_of(spark, '{"B": "x", "A": true}').collect()] == [(0, "B", "x"), (1, "A", "true")]
    assert requests.mapping_of(spark, "[1").count() == 0
    spark.conf.set("spark.palimpsest.attempts", "3")
    assert requests.Settings.of(spark).attempts == 3 and requests.Settings.of(spark).chunk_size == "max"
    client = requests.Settings(requests_per_minute=100, tokens_per_minute=900).client(str.upper, workers=4)
    assert (client.limiter.requests, client.limiter.tokens, client.attempts) == (25, 225, 5)
    assert all(r.mock for r in requests.listing_or_demo(spark, "/no/such/folder/").collect())


def test_properties(spark):
    own = spark.createDataFrame([("a", docx.made([["x"]], header=" ")), ("b", b"broken")], "path string, content binary")
    got = {r.path: r for r in docx.properties(own).collect()}
    assert got["a"].has_headers and not got["a"].has_footers and got["a"].error is None and got["b"].error


def test_written_files_are_found_and_read(spark, tmp_path):
    from palimpsest.streaming import folder

    at = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"f{k}.docx", docx.made([[f"text {k}"]])) for k in range(3)], "name string, content binary")
    assert sinks.save_files(rows, at).filter("error is null").count() == 3
    assert {(r.name, r.size > 0) for r in docx.listing(spark, at).collect()} == {(f"f{k}.docx", True) for k in range(3)}
    read = docx.elements(docx.files(spark, at).select("path", "content"))
    assert {r.text for r in read.collect()} == {f"text {k}" for k in range(3)}
    assert {(r.text, r.status) for r in requests.parsed(docx.files(spark, at)).collect()} == {(f"text {k}", "local") for k in range(3)}
    # The same operators over the folder as a stream.
    stream = docx.elements(folder.dropped_files(spark, at).select("path", "content"))
    query = stream.writeStream.format("memory").queryName("dropped").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.text for r in spark.table("dropped").collect()} == {f"text {k}" for k in range(3)}
    assert sinks.write_files(rows, str(tmp_path / "packed")).count() == 3


def test_many_small_files_share_batches():
    """A batch for each file would cost more than reading it."""
    import pyarrow as pa

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    own = pa.record_batch([pa.array(map(str, range(100))), pa.array([docx.made([["a"], ["b"]])] * 99 + [b"broken"])], names=["path", "content"])
    for read, rows in ((docx.elements, 199), (docx.properties, 100)):
        made = list(read(Frame())([own]))
        assert len(made) == 1 and made[0].num_rows == rows


def test_elements_and_flags_read_a_file_once_each(spark):
    import __spark_entry__

    made = __spark_entry__.queries()["elements_by_path"](spark, "/root/testdata/sf0.001")
    assert made.count() and made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 4


def test_contexts_are_read_once(spark):
    own = spark.createDataFrame([(1, docx.made([["{{A}}"]]))], "doc_id long, content binary")
    sources = spark.createDataFrame([(0, "A", "text", True, None)], "ord int, name string, text string, success boolean, error string")
    made = files.smart_fill(own, sources, "{placeholder_name}\n{source_text}", extracting)
    # Filling, and the replies' contents; no reading of contexts.
    assert made.first().details == {"A": "A: text"} and made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_parts_that_do_not_change_are_taken_over_as_stored():
    """A stored picture stays stored, a damaged one is still an error, and the file is one that zipfile reads."""
    import io
    import zipfile

    import pytest

    from palimpsest.sources import docx

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(docx.made([["Hello ", "Ann"]], [["x"]], "Top"))) as z, zipfile.ZipFile(out, "w") as to:
        for name in z.namelist():
            to.writestr(name, z.read(name), zipfile.ZIP_BZIP2 if name == "_rels/.rels" else zipfile.ZIP_DEFLATED)
        to.writestr("word/media/bild é.png", b"picture " * 50, zipfile.ZIP_STORED)
    content = out.getvalue()
    plain = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(plain, "w", zipfile.ZIP_DEFLATED) as to:
        for item in z.infolist():
            if item.compress_type != zipfile.ZIP_BZIP2:
                to.writestr(item, z.read(item))

    def changed(content: bytes) -> zipfile.ZipFile:
        d = docx.Document(content)
        return zipfile.ZipFile(io.BytesIO(d.written([["Hello ", "Zoe"] if runs == ["Hello ", "Ann"] else runs for *_, runs in d.paragraphs])))

    for given in (content, plain.getvalue()):
        made, was = changed(given), zipfile.ZipFile(io.BytesIO(given))
        assert made.testzip() is None and made.namelist() == was.namelist()
        assert [n for n in made.namelist() if made.read(n) != was.read(n)] == ["word/document.xml"] and b"Zoe" in made.read("word/document.xml")
    assert made.getinfo("word/media/bild é.png").compress_type == zipfile.ZIP_STORED
    with pytest.raises(zipfile.BadZipFile):
        changed(plain.getvalue().replace(b"picture picture", b"picture_picture", 1))


def test_links_are_those_of_the_parsed_sections():
    import io
    import zipfile

    from palimpsest.sources import docx

    w, r = docx._W[1:-1], docx._R[1:-1]
    link = lambda kind, k, sort="": f'<w:{kind}Reference {sort} r:id="{k}"/>'
    first = "<w:p><w:pPr><w:sectPr>" + link("footer", "f1") + link("header", "h2", 'w:type="first"') + "<w:sectPrChange><w:sectPr>" + link("header", "h3") + "</w:sectPr></w:sectPrChange>" + link("header", "h1") + "</w:sectPr></w:pPr></w:p>"
    xml = f'<w:document xmlns:w="{w}" xmlns:r="{r}"><w:body>{first}<w:sectPr>{link("header", "h1")}{link("footer", "none")}</w:sectPr></w:body></w:document>'.encode()
    rels = "<R>" + "".join(f'<x Id="{k}" Target="{k}.xml"/>' for k in ("f1", "h1", "h2", "h3")) + "</R>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/_rels/document.xml.rels", rels)
        z.writestr("word/document.xml", xml)
        for k in ("f1", "h1", "h2", "h3"):
            z.writestr(f"word/{k}.xml", "<a/>")
    z = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    want = [("header", "word/h1.xml"), ("footer", "word/f1.xml"), ("header", "word/h3.xml")]
    assert docx.linked_parts(z) == want == docx.linked_parts(z, links=docx._Edit(xml, "body").links)
