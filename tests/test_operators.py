import io
import zipfile

from palimpsest.functions import text as T
from palimpsest.operators import contexts, entities, matching
from palimpsest.sources import docx
from pyspark.sql import functions as F

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def document(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{W}"><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>')
    return out.getvalue()


BODY = (
    "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Hello </w:t></w:r><w:r><w:t>{{NAME}}</w:t></w:r></w:p><w:p/>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
)


def test_docx(spark):
    rows = docx.elements(spark.createDataFrame([("a", document(BODY)), ("b", b"broken")], "path string, content binary")).collect()
    good = sorted((r.seq, r.text, r.element_type, r.is_bold) for r in rows if r.path == "a")
    assert good == [(0, "Hello {{NAME}}", "paragraph", True), (1, "cell", "table_cell", False), (2, "Top", "header", False)]
    assert [r.error for r in rows if r.path == "b"][0]
    flat = docx.flat_text(spark.createDataFrame([("a", document(BODY))], "path string, content binary")).first().text
    assert flat == "Hello {{NAME}}\n\n\n\ncell"
    new = docx.written(document(BODY), {("body", 0): ["Hello ", "Ann"]})
    assert next(iter(docx.parse(new)))[1] == "Hello Ann"


def test_detection(spark):
    text = "On January 5, 2024 Mr John Smith paid £5,000 or 3.5% to a@b.com. 2024 {{DATE}}"
    found = entities.detect(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    kept = entities.reconcile(found).orderBy("ord").collect()
    originals = [r.original for r in kept]
    assert "January 5, 2024" in originals and "2024" not in originals and "a@b.com" in originals
    assert originals == sorted(originals, key=lambda s: -len(s))


def test_first_of_equal_detections_wins(spark):
    rows = [(1, 0, "Ann", "{{A}}", "A", 0.8, ""), (1, 1, " ann ", "{{B}}", "B", 0.8, ""), (1, 2, "ANN", "{{C}}", "C", 0.9, "")]
    d = spark.createDataFrame(rows, "doc_id long, seq long, original string, placeholder string, category string, confidence double, reason string")
    assert [r.category for r in entities.best_of_each(d).collect()] == ["C"]
    assert [r.category for r in entities.best_of_each(d.filter("seq < 2")).collect()] == ["A"]


def test_contexts(spark):
    rows = [(1, 0, "x {{A}}", "Normal"), (1, 1, "Title", "Heading 1"), (1, 2, "b {{B}} {{A}}", "Normal"), (1, 3, "Last", "Heading 2"), (2, 0, "{{C}}", None)]
    got = {(r.doc_id, r.placeholder_name): r for r in contexts.paragraph_contexts(spark.createDataFrame(rows, "doc_id long, seq int, text string, style_name string")).collect()}
    assert got[1, "A"].section_heading == "Last" and got[1, "A"].full_paragraph == "x {{A}}"
    assert got[1, "B"].section_heading == "Title" and got[1, "B"].before_text == "x {{A}}\nTitle"
    assert got[2, "C"].section_heading == "Document Start" and got[2, "C"].before_text == ""


def test_cell_contexts(spark):
    rows = [(1, 0, 0, 0, 0, "up"), (1, 0, 1, 0, 0, "l2"), (1, 0, 1, 1, 0, "l1"), (1, 0, 1, 2, 0, "in {{A}}"), (1, 0, 1, 2, 1, "later"), (1, 0, 2, 0, 0, "down")]
    r = contexts.cell_contexts(spark.createDataFrame(rows, "doc_id long, table_index int, row_index int, cell_index int, paragraph_index int, text string")).first()
    assert (r.before_text, r.after_text) == ("l1\nl2\nup", "later\ndown")


def test_prefixes(spark):
    names = spark.createDataFrame([("RISK_HIGH",), ("RISK",), ("EMPTY_X",), ("NONE",)], "name string")
    entries = spark.createDataFrame([(0, "RI", "first"), (1, "RISK", "own"), (2, "EMPTY", "")], "ord int, name string, content string")
    assert {r.name: r.content for r in matching.by_prefix(names, entries).collect()} == {"RISK_HIGH": "first", "RISK": "own"}


def test_text_expressions(spark):
    d = spark.createDataFrame([("  a\r\n\r\n\r\nb\r ",)], "x string")
    r = d.select(T.normal_text(F.col("x")).alias("n"), T.splice(F.lit("abcdef"), F.lit(2), F.lit(4), F.lit("--")).alias("s"), T.fold_alnum(F.lit("A-b é!")).alias("f"), T.has_extension(F.lit("x.PDF")).alias("e")).first()
    assert (r.n, r.s, r.f, r.e) == ("a\n\nb", "ab--ef", "abé", True)


def test_all_patterns_over_documents(spark, tmp_path):
    import re
    from collections import Counter

    import __spark_entry__
    from palimpsest.functions.catalog import PATTERNS

    rows = [(1, "Call +44 20 7946 0958 or 555-123-4567 by 3/4/2024; fee $1,200.50, 3.5% to a@b.com"), (2, "Mr Alan Marsh paid EUR 30 on January 5, 2024, or 2024-01-05"), (3, "tel 555-123-4567 2024"), (4, None), (5, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n, docs = Counter(), {}
    for doc, text in rows:
        best = {}
        for category, _, pattern in PATTERNS:
            for m in re.finditer(pattern, text or "", re.IGNORECASE):
                best.setdefault(m[0].strip().lower(), (m[0], category))
        for original, category in best.values():
            if not any(original in o and original != o for o, _ in best.values()):
                n[category] += 1
                docs.setdefault(category, set()).add(doc)
    want = {c: (n[c], len(docs[c])) for c in n}
    got = {r.category: (r.n, r.docs) for r in __spark_entry__.queries()["all_entity_counts"](spark, str(tmp_path)).collect()}
    assert got == want and {"PHONE", "CURRENCY", "DATE", "EMAIL"} <= set(got)


def test_model_and_pattern_detections_are_united(spark):
    from palimpsest.operators import classify

    def client(prompt):
        if "fails" in prompt:
            raise OSError("no answer")
        if "errs" in prompt:
            return '{"error": "limit", "replacements": []}'
        if "Bob" in prompt:
            return '```json\n{"replacements": [{"original": "Bob", "placeholder": "NAME", "category": "CUSTOMER_NAME"}, {"original": "Zoe"}, {"original": "A@b.com", "placeholder": "{{X}}", "category": "X", "confidence": 0.95}]}\n```'
        return "no json"

    rows = [(1, "Bob has A@b.com and 3%"), (2, "fails for c@d.com"), (3, "errs for 4%"), (4, "else 5%"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.original, r.placeholder, r.category, r.confidence) for r in classify.classify(docs, "{text_chunk}", client).collect()}
    assert got == {
        (1, "Bob", "{{CUSTOMER_NAME}}", "CUSTOMER_NAME", 0.9), (1, "A@b.com", "{{X}}", "X", 0.95), (1, "3%", "{{PERCENTAGE}}", "PERCENTAGE", 0.8),
        (2, "c@d.com", "{{EMAIL}}", "EMAIL", 0.8), (3, "4%", "{{PERCENTAGE}}", "PERCENTAGE", 0.8), (4, "5%", "{{PERCENTAGE}}", "PERCENTAGE", 0.8),
    }
    chunks = docs.filter("text is not null").withColumn("chunk_index", F.lit(0))
    by_chunk = {(r.doc_id, r.original) for r in classify.chunk_detections(chunks, "{text_chunk}", client).collect()}
    assert by_chunk == {(1, "Bob"), (1, "A@b.com"), (2, "c@d.com"), (3, "4%"), (4, "5%")}


def test_detections_of_large_documents_are_never_broadcast(spark):
    """Small tables too are merged, so nothing of a document goes through the driver."""
    rows = [(1, "Customer#00012"), (1, "omer#0001"), (1, "12"), (1, "#"), (2, "omer#0001"), (2, "x")]
    kept = entities.maximal(spark.createDataFrame(rows, "doc_id long, original string"), in_row=0)
    assert sorted(map(tuple, kept.collect())) == [(1, "Customer#00012"), (2, "omer#0001"), (2, "x")]
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()


def test_names_of_two_categories_are_detected_in_one_pass(spark):
    import __spark_entry__

    made = __spark_entry__.queries()["sorted_names"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("regexp_extract_all") == len(entities.patterns_of("DATE", "EMAIL")) == 7


def test_an_earlier_phase_comes_first(spark):
    from palimpsest.operators import classify

    docs = spark.createDataFrame([(1, "3%")], "doc_id long, text string")
    earlier = entities.detect(docs).withColumn("reason", F.lit("earlier phase"))
    plan = classify.classify(docs, "{text_chunk}", paragraphs=earlier)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("earlier phase") < plan.index("MapInArrow")


def test_quick_patterns_match_as_the_catalogue_does(spark):
    """Random texts of what patterns are made of: each pattern behind its gate finds what it finds as it is written."""
    import random

    from palimpsest.functions.catalog import PATTERNS

    draw = random.Random(7)
    bits = ["1", "23", "4,5", "678", ".", "..", ",", " ", "  ", " ", "%", "percent", "PerCent", "per cent", "percen", "USD", "uſd", "usD", "EUR", "euros", "pound", "pounds", "dollar", "p.a.", "per annum", "P.A", "annually", "/month", "per month",
            "£", "$", "€", "¥", "m", "Million", "k", "K", "Mr", "Mr.", "Mrs", "ſr", "Miss", "Dr", " Al", " Bo", "January", "ſeptember", "May", "Sept", "Jan.", "st", "th", " of ", "Q1", "h2", "Q7", "1995", "2024", "/", "-", "+", "(", ")", "a", "é", "_", "x@y.de", "@", "b.c@d", ".com", "|", "٣", "٣٤", "\n", "ı", "İ",
            "1/23/95", "1995-4-05", "3rd of May 1995", "ſeptember 4, 1995", "Dec. 25 2024", "+44 (20) 555-1234", "Mr Al Bo", "mıss İda Bo"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 40))) for _ in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    plain = F.array(*[F.regexp_extract_all("text", F.lit(entities.FLAGS + x), F.lit(0)) for _, _, x in PATTERNS])
    quick = F.array(*[F.transform(entities.hits_in(F.col("text"), [x]), lambda h: h["original"]) for x in PATTERNS])
    rows = docs.select("text", plain.alias("plain"), quick.alias("quick")).collect()
    assert [r for r in rows if r.plain != r.quick][:1] == []
    assert all(any(r.plain[k] for r in rows) for k in range(len(PATTERNS)))
    # Gates name letters of ASCII: no other character is one of theirs, case ignored, but the long s.
    beyond = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    assert spark.createDataFrame([(beyond,)], "t string").select(F.regexp_extract_all("t", F.lit("(?iU)[percntaumohusdglby]"), F.lit(0))).first()[0] == ["ſ"]


def test_long_numbers_are_read_once(spark):
    """A number of thousands of digits is no work of its length cubed."""
    import time

    docs = spark.createDataFrame([(1, "7" * 4000 + " percent per cent month USD 5 %")], "doc_id long, text string")
    began = time.time()
    found = {r.original for r in entities.detect(docs).collect() if r.category == "PERCENTAGE"}
    assert found == {"5 %", "7" * 4000 + " percent"} and time.time() - began < 60


def test_strip_takes_what_unicode_calls_white(spark):
    """Trimmed ends are those of the pattern for white space; a text of blanks with an end is no work of its length squared."""
    import time

    ends = [chr(c) for c in (*range(0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    texts = [None, "", " ", "\r\n", "a 　b", *[x + " a" + y + "b\n" + x for x in ends for y in ends], *[f"{x}a{x} " for x in ends]]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    assert docs.filter(~T.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    began = time.time()
    assert spark.createDataFrame([("a" + " " * 200_000 + "b ",)], "t string").select(F.length(T.strip(F.col("t")))).first()[0] == 200_002
    assert time.time() - began < 30


def test_lists_are_reconciled_as_rows_are(spark):
    """Random detections: lists sorted in their row give what grouping, containment and ordering of rows give, in one aggregation."""
    import random

    draw = random.Random(11)
    rows = [(d, k, draw.choice(["", " "]) + "".join(draw.choices("aAb c", k=draw.choice([1, 2, 3, 5]))) + draw.choice(["", "\t"]), f"{{{{P{k}}}}}", "C", draw.choice([0.5, 0.8, 0.9]), "") for d in range(60) for k in range(25)]
    names = "doc_id long, seq long, original string, placeholder string, category string, confidence double, reason string"
    d = spark.createDataFrame(rows, names).filter("original <> ''")
    get = lambda x: sorted(map(tuple, x.select("doc_id", "ord", "original", "placeholder", "confidence", "seq", "group_seq").collect()))
    want = get(entities.longest_first(entities.maximal(entities.best_of_each(d))))
    lists = d.select("doc_id", F.array(F.struct(*[c for c in d.columns if c != "doc_id"])).alias("hits"))
    assert get(entities.reconcile(d)) == want == get(entities.reconcile_lists(lists)) and len(want) > 200
    plan = entities.reconcile_lists(lists)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Window" not in plan


def test_documents_are_dealt_before_detection(spark):
    """One row group of documents is detected in as many tasks as there are, and the digit gate knows every digit."""
    import __spark_entry__

    made = __spark_entry__.queries()["all_entity_counts"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.index("regexp_extract_all") < plan.index("RepartitionByExpression")
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    two = spark.createDataFrame([(every,)], "t string").select(*[F.regexp_extract_all("t", F.lit(x), F.lit(0)).alias(n) for n, x in (("a", r"\p{Nd}"), ("b", r"\p{IsDigit}"), ("c", r"(?iU)\d"))]).first()
    assert two.a == two.b == two.c and len(two.a) > 500
