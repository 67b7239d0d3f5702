"""Whole files in, whole files out: rebuilding and filling documents held in a binary column.

Files are rows (doc_id, content). What is put into a file comes from a table, as one list for each id, and is joined
to it; nothing is sent to all executors and a model is asked once for each place. A file that can't be read or
written gives a row with its error and no content.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import PLACEHOLDER, PLACEHOLDER_NO_DIGITS
from palimpsest.operators import contexts, lanes, matching, model
from palimpsest.operators.rebuild import rebuild
from palimpsest.sources import docx
from palimpsest.sources.batches import slices
from palimpsest.sources.shared import stored

_KINDS = {"binary": pa.binary(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
_REBUILT = {"content": "binary", "applied": "int", "failed": "array<string>"}
_FILLED = {"content": "binary", "found": "int", "filled": "int", "unfilled": "array<string>"}
#: Parts that the plain filler reads and writes, and those of the filler by context.
TOLD = 64_000  # characters of messages on unread sources that a file's row holds
PLAIN_PARTS, CONTEXT_PARTS = ("body", "cell", "header", "footer"), ("body", "cell")


def _per_file(files: DataFrame, given: DataFrame, work: Callable[[bytes, list[dict]], tuple], failed: tuple, columns: dict[str, str]) -> DataFrame:
    """doc_id, what ``work`` makes of each file's bytes and its given rows, success, error; ``failed`` where it raises."""
    lists = given.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in given.columns if c != "doc_id"])).alias("given"))
    names = ["doc_id", *columns, "success", "error"]

    def run(batches):
        for b in slices(batches):
            rows = []
            for doc, content, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "content", "given"))):
                try:
                    rows.append((doc, *work(content, own or []), True, None))
                except Exception as e:  # noqa: BLE001 - any damage belongs to its file
                    rows.append((doc, *failed, False, f"{type(e).__name__}: {e}"))
            kinds = [pa.int64(), *[_KINDS[k] for k in columns.values()], pa.bool_(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names=names)

    schema = "doc_id long, " + ", ".join(f"{n} {k}" for n, k in columns.items()) + ", success boolean, error string"
    return files.select("doc_id", "content").join(lists, "doc_id", "left").mapInArrow(run, schema)


def rebuild_files(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """Each file with its replacements (doc_id, ord, original, placeholder) applied, longest first, as a new file."""

    def work(content: bytes, own: list[dict]) -> tuple:
        document = docx.Document(content)
        pairs = [(r["original"], r["placeholder"]) for r in sorted(own, key=lambda r: r["ord"])]
        runs, applied, failed = rebuild(document.paragraphs, pairs)
        return document.written(runs), applied, failed

    given = replacements.select(*[F.col(c).alias(c) for c in ("doc_id", "ord", "original", "placeholder")])
    return _per_file(files, given, work, (None, 0, []), _REBUILT)


def filled_runs(runs: list[str], name: str, content: str) -> list[str] | None:
    """A paragraph's runs with a placeholder filled, or None: the first run that holds it, else all of its text in the first run."""
    for k, r in enumerate(runs):
        if name in r:
            return [*runs[:k], r.replace(name, content), *runs[k + 1 :]]
    whole = "".join(runs)
    return [whole.replace(name, content), *[""] * (len(runs) - 1)] if name in whole else None


def _fill(content: bytes, pairs: list[tuple[str, str]], parts: tuple[str, ...]) -> tuple[bytes, set[str]]:
    """The file with (name, content) pairs filled one after the other, and the names that stood in it."""
    document, filled = docx.Document(content), set()
    runs = [p[3] for p in document.paragraphs]
    for name, put in pairs:
        for k, (part, *_) in enumerate(document.paragraphs):
            if part in parts and (changed := filled_runs(runs[k], "{{" + name + "}}", put)) is not None:
                runs[k] = changed
                filled.add(name)
    return document.written(runs), filled


def placeholder_names(files: DataFrame, pattern: str = PLACEHOLDER_NO_DIGITS, parts: tuple[str, ...] = PLAIN_PARTS) -> DataFrame:
    """(doc_id, name): the distinct placeholders in each file; a file that can't be read has none."""
    named = re.compile(pattern)

    def run(batches):
        for b in batches:
            ids, names = [], []
            for doc, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist()):
                try:
                    found = {n for part, _, _, runs in docx.Document(content).paragraphs if part in parts for n in named.findall("".join(runs))}
                except Exception:  # noqa: BLE001 - filling tells the error
                    found = set()
                ids += [doc] * len(found)
                names += sorted(found)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(names, pa.string())], names=["doc_id", "name"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, name string").distinct()


def fill_files(files: DataFrame, mapping: DataFrame, pattern: str = PLACEHOLDER_NO_DIGITS) -> DataFrame:
    """Each file with its placeholders filled, in the order of their names, from ``mapping`` (name, content); names without content are told."""
    known = mapping.filter("name is not null and content is not null").groupBy("name").agg(F.min("content").alias("put"))
    given = placeholder_names(files, pattern).join(known, "name", "left").select("doc_id", "name", "put")

    def work(content: bytes, own: list[dict]) -> tuple:
        rows = sorted(own, key=lambda r: r["name"])
        made, filled = _fill(content, [(r["name"], r["put"]) for r in rows if r["put"] is not None], PLAIN_PARTS)
        return made, len(rows), len(filled), [r["name"] for r in rows if r["name"] not in filled]

    return _per_file(files, given, work, (None, 0, 0, []), _FILLED)


def _contexts(content: bytes) -> list[tuple[str, int, str, str, str, str]]:
    """(name, place, before, after, heading, paragraph) of each name's first place in a file, the body before tables."""
    rows = list(docx.parse(content, blanks=True))
    body = [r for r in rows if r[2] == "paragraph"]
    heads = [(k, r[1]) for k, r in enumerate(body) if "Heading" in (r[7] or "")]
    last = heads[-1][1] if heads else "Document Start"
    found: dict[str, tuple] = {}

    def add(text: str, before: list[str], after: list[str], heading: str) -> None:
        for name in _NAMED.findall(text):
            if name not in found:
                found[name] = (name, len(found), "\n".join(before)[-contexts.WIDTH :], "\n".join(after)[: contexts.WIDTH], heading, text)

    texts, at, heading = [r[1] for r in body], 0, last
    for k, text in enumerate(texts):
        while at < len(heads) and heads[at][0] < k:
            heading = heads[at][1]
            at += 1
        add(text, texts[max(0, k - contexts.NEAR) : k], texts[k + 1 : k + 1 + contexts.NEAR], heading)
    cells: dict[tuple[int, int], dict[int, list[str]]] = {}
    for r in rows:
        if r[2] == "table_cell":
            cells.setdefault((r[4], r[5]), {}).setdefault(r[6], []).append(r[1])
    for (table, line), row in cells.items():
        order = sorted(row)
        text_of = {c: "\n".join(row[c]) for c in order}
        above, below = cells.get((table, line - 1)), cells.get((table, line + 1))
        for place, c in enumerate(order):
            left = [text_of[x] for x in order[max(0, place - 2) : place]][::-1]
            right = [text_of[x] for x in order[place + 1 : place + 3]]
            up = ["\n".join(above[max(above)])] if above else []
            down = ["\n".join(below[min(below)])] if below else []
            for k, text in enumerate(row[c]):
                add(text, row[c][:k] + left + up, row[c][k + 1 :] + right + down, last)
    return list(found.values())


_NAMED = re.compile(PLACEHOLDER)
_CONTEXT = "doc_id long, placeholder_name string, place int, before_text string, after_text string, section_heading string, full_paragraph string"


def file_contexts(files: DataFrame) -> DataFrame:
    """(doc_id, placeholder_name, place, before_text, after_text, section_heading, full_paragraph): first places, the body before tables.

    What ``contexts`` says of tables of paragraphs and cells; of a file it is found where the file is read, without a
    shuffle. A name in a table has the document's last heading. ``place`` orders the names of a file.
    """

    def run(batches):
        for b in slices(batches):
            rows = []
            for doc, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows += [(doc, *r) for r in _contexts(content)]
                except Exception:  # noqa: BLE001 - filling tells the error
                    continue
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=[x.split(" ")[0] for x in _CONTEXT.split(", ")])

    return files.select("doc_id", "content").mapInArrow(run, _CONTEXT)


def smart_fill(files: DataFrame, sources: DataFrame, template: str, client: model.Client = model.silent, prefixes: bool = True, **calls) -> DataFrame:
    """Each file with its placeholders filled by what the client finds for them in their source's text.

    ``sources`` (ord, name, text, success, error) are read documents by placeholder name or, with ``prefixes``, by what
    names begin with. ``template`` has {placeholder_name}, {section_heading}, {before_text}, {after_text}, {full_paragraph}
    and {source_text}. Result: doc_id, content, found, filled, unfilled, success, error, details (name: first 100
    characters, with an ellipsis where something is cut, always without ``prefixes``), errors. The client is asked once
    for each distinct prompt, when this is called; ``calls`` are parameters of ``lanes.answered``. Contexts are stored, as
    names, prompts and what is filled are made of them.
    """
    around = stored(file_contexts(files), "contexts")
    usable = sources.filter("success and coalesce(text, '') <> ''").select("ord", "name", F.col("text").alias("content"))
    names = around.select(F.col("placeholder_name").alias("name")).distinct()
    matched = matching.by_prefix(names, usable) if prefixes else matching.by_name(names, usable).filter("content is not null")
    asked = around.join(matched.select(F.col("name").alias("placeholder_name"), F.col("content").alias("source_text")), "placeholder_name", "left")
    fields = {c: F.col(c) for c in ("placeholder_name", "section_heading", "before_text", "after_text", "full_paragraph")}
    prompt = F.when(F.col("source_text").isNotNull(), model.prompt_for_context(template, fields, F.col("source_text")))
    prompts = asked.select("doc_id", "placeholder_name", "place", prompt.isNotNull().alias("asked"), prompt.alias("prompt"))
    # A prompt holds its source's text, so it is left behind before replies are read.
    replies = model.contents((model.ask(prompts, client) if client is model.silent else lanes.answered(prompts, client, **calls)).drop("prompt", "error"))
    given = replies.select("doc_id", F.col("placeholder_name").alias("name"), "place", "asked", F.nullif(F.col("content"), F.lit("")).alias("put"))

    def work(content: bytes, own: list[dict]) -> tuple:
        rows = sorted(own, key=lambda r: r["place"])
        made, filled = _fill(content, [(r["name"], r["put"]) for r in rows if r["put"] is not None], CONTEXT_PARTS)
        details = {r["name"]: r["put"][:100] + ("..." if not prefixes or len(r["put"]) > 100 else "") for r in rows if r["put"] is not None}
        return made, len(rows), len(filled), sorted(r["name"] for r in rows if r["name"] not in filled), list(details.items()), [f"no content for {r['name']}" for r in rows if r["asked"] and r["put"] is None]

    done = _per_file(files, given, work, (None, 0, 0, [], [], []), {**_FILLED, "details": "map<string,string>", "errors": "array<string>"})
    # One row in all, of a checked size: the sources that could not be read, or how many they are.
    told = F.concat(F.lit("not read: "), F.col("name"), F.lit(": "), F.coalesce("error", F.lit("")))
    size, n = sources.filter("not success").agg(F.sum(F.length(told)), F.count("*")).first()
    if (size or 0) > TOLD:
        return done.withColumn("errors", F.concat(F.array(F.lit(f"{n} sources not read")), "errors"))
    unread = sources.filter("not success").agg(F.array_sort(F.collect_list(told)).alias("unread"))
    return done.join(F.broadcast(unread)).withColumn("errors", F.concat("unread", "errors")).drop("unread")
