"""Substitution in a document's paragraphs: a fold in which later replacements see earlier ones.

One document is one group; the fold runs in Python, as its steps are stateful.
Paragraphs are rows (doc_id, part, seq, runs): ``part`` is body, cell, header,
footer, header_cell or footer_cell, ``runs`` the texts of equal formatting.
"""

from __future__ import annotations

import difflib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.catalog import PATTERNS
from palimpsest.operators import hits
from palimpsest.sources.batches import gathered, objects, slices
from palimpsest.sources.shared import stored

#: Parts whose paragraphs may be matched as a sequence.
SEQUENCES = ("body", "cell", "header_cell")
#: Letters and digits of a seed.
GRAM = 6


#: Of characters of one byte: their small letters, which are of one byte too, and those that are no letters or digits.
_SMALL = "".join(map(chr, range(256))).lower().encode("latin-1")
_MARKS = bytes(c for c in range(256) if not chr(c).isalnum())


@lru_cache(maxsize=4096)
def _letters(text: str) -> str:
    """The letters and digits in small letters."""
    try:
        return text.encode("latin-1").translate(_SMALL, _MARKS).decode("latin-1")
    except UnicodeEncodeError:
        # One by one, as the small form of some depends on what stands around them.
        return "".join([c.lower() for c in text if c.isalnum()])


def _places(text: str) -> list[int]:
    """The place in the text of each of its ``_letters``."""
    return [k for k, c in enumerate(text) if c.isalnum() for _ in c.lower()]


def _spaced(words: list[str], text: str) -> tuple[int, int] | None:
    """The first place where the words stand one after the other, with any white space or none between them."""
    at = text.find(words[0])
    while at >= 0:
        end = at + len(words[0])
        for word in words[1:]:
            while text[end : end + 1].isspace():
                end += 1
            if not text.startswith(word, end):
                break
            end += len(word)
        else:
            return at, end
        at = text.find(words[0], at + 1)
    return None


def span_of(original: str, text: str) -> tuple[int, int] | None:
    """Where the original stands in a text: white space aside, then all but letters and digits aside, then its longest common block.

    A match with white space aside is one of letters and digits too, and a common block of more than 0.7 of the
    original holds its middle; so most texts without a match are told by two searches, the others by those for blocks of the least
    number of characters that is more than 0.7 of it.
    """
    needle = _letters(original)
    at = _letters(text).find(needle) if needle else -1
    if at >= 0 or not needle:
        words = original.split()
        if words and (span := _spaced(words, text)):
            return span
    if at >= 0:
        places = _places(text)
        return places[at], places[at + len(needle) - 1] + 1
    n = len(original)
    if not original or original[-(-3 * n // 10) : 7 * n // 10] not in text:
        return None
    least = 7 * n // 10 + 1
    if not any(original[k : k + least] in text for k in range(n - least + 1)):
        return None
    block = difflib.SequenceMatcher(None, original, text).find_longest_match(0, n, 0, len(text))
    return (block.b, block.b + block.size) if block.size / n > 0.7 else None


def put(runs: list[str], start: int, end: int, new: str) -> list[str]:
    """Runs with [start, end) of their joined text replaced: the first run keeps its beginning, the last its end."""
    out, at, placed = [], 0, False
    for r in runs:
        a, b = max(start, at), min(end, at + len(r))
        if a < b or (not placed and start == end == a):
            out.append(r[: a - at] + ("" if placed else new) + r[b - at :])
            placed = True
        else:
            out.append(r)
        at += len(r)
    return out


def replace_in(runs: list[str], original: str, new: str) -> list[str] | None:
    """The paragraph's runs with the original replaced, or None. In a run that holds it whole all its places count."""
    if not original.strip():
        return None
    for k, r in enumerate(runs):
        if original in r:
            return [*runs[:k], r.replace(original, new), *runs[k + 1 :]]
    span = span_of(original, "".join(runs))
    return put(runs, *span, new) if span else None


def sequence_at(original: str, texts: list[str]) -> tuple[int, int] | None:
    """(first, number) of paragraphs in a row that hold the lines of an original of two lines or more."""
    if "\n" not in original:
        return None
    fold = lambda s: " ".join(s.split())
    lines = [fold(x) for x in original.split("\n") if x.strip()]
    if len(lines) < 2:
        return None
    folded = list(map(fold, texts))
    for at in range(len(folded) - len(lines) + 1):
        if all(line in folded[at + k] for k, line in enumerate(lines)):
            return at, len(lines)
    return None


def seeds_of(original: str) -> list[str] | None:
    """What a paragraph's letters and digits must hold, one of them at least, for the original to match there; None if that can't be said.

    Each of the three ways to match implies that the original's middle stands in the paragraph, white space, marks and
    case aside. The lines of a sequence stand whole, so their longest one serves.
    """
    n = len(original)
    seeds = [_letters(original[-(-3 * n // 10) : 7 * n // 10])]
    lines = [x for x in original.split("\n") if x.strip()]
    if len(lines) > 1:
        seeds.append(max((_letters(x) for x in lines), key=len))
    if any(len(s) < GRAM for s in seeds):
        return None
    return [s[(len(s) - GRAM) // 2 :][:GRAM] for s in seeds]


def rebuild(paragraphs: list[tuple[str, int, int, list[str]]], replacements: list[tuple[str, str]], near: dict[int, set[int]] | None = None) -> tuple[list[list[str]], int, list[str]]:
    """(runs of each paragraph, number applied, originals not found). paragraphs: (part, group, seq, runs); replacements in order given, longest first here.

    ``near`` names, for each replacement by its place, the paragraphs that can match it as they are; one that is not
    named can match any. A paragraph that has changed is tried with all that follow.
    """
    runs, applied, failed = [list(p[3]) for p in paragraphs], 0, []
    groups: dict[tuple[str, int], list[int]] = {}
    for k, (part, group, *_) in enumerate(paragraphs):
        groups.setdefault((part, group), []).append(k)
    of = {k: key for key, own in groups.items() for k in own}
    changed: set[int] = set()
    texts = ["".join(x) for x in runs]
    letters: list[str | None] = [None] * len(texts)
    for place, (original, new) in sorted(enumerate(replacements), key=lambda r: -len(r[1][0])):
        tried = groups
        if near is not None and place in near:
            tried = {}
            for k in sorted(near[place] | changed):
                tried.setdefault(of[k], []).append(k)
        hit, n, needle = False, len(original), _letters(original)
        middle = original[-(-3 * n // 10) : 7 * n // 10]
        for key, own in tried.items():
            found = False
            for k in own:
                if needle and original not in texts[k]:
                    if letters[k] is None:
                        letters[k] = _letters(texts[k])
                    # A text that holds neither can't match (``span_of``).
                    if needle not in letters[k] and middle not in texts[k]:
                        continue
                if (made := replace_in(runs[k], original, new)) is not None:
                    runs[k], found = made, True
                    texts[k] = "".join(made)
                    letters[k] = None
                    changed.add(k)
            if not found and key[0] in SEQUENCES and "\n" in original and (at := sequence_at(original, [texts[k] for k in groups[key]])):
                first, n = at
                for j in range(n):
                    k = groups[key][first + j]
                    runs[k] = [new] if j == 0 else [""]
                    texts[k] = runs[k][0]
                    letters[k] = None
                    changed.add(k)
                found = True
            hit |= found
        applied += hit
        if not hit:
            failed.append(original)
    return runs, applied, failed


_SCHEMA = "doc_id long, part string, grp int, seq int, text string, applied int, failed array<string>"
_PARAGRAPH = "struct<part:string,grp:int,seq:int>"


def candidate_pairs(paragraphs: DataFrame, replacements: DataFrame) -> DataFrame:
    """(doc_id, ord, seeded, near): the paragraphs (part, grp, seq) that each replacement can match.

    A replacement's seeds meet the paragraphs' runs of ``GRAM`` letters and digits in a join on document and seed, so
    a document's pairs are found in as many tasks as there are; ``seeded`` is false, and ``near`` empty, for one that any
    paragraph may match.
    """

    def sown(batches):
        for b in slices(batches):
            rows = []
            for doc, ord_, original in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ord", "original"))):
                seeds = seeds_of(original or "")
                rows += [(doc, ord_, s) for s in set(seeds)] if seeds else [(doc, ord_, None)]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "ord", "seed"])

    def grown(batches):
        for b in slices(batches):
            folded = [_letters("".join(runs or [])) for runs in b.column("runs").to_pylist()]
            grams = pa.array([list({x[k : k + GRAM] for k in range(len(x) - GRAM + 1)}) for x in folded], pa.list_(pa.string()))
            yield pa.record_batch([*[b.column(c) for c in ("doc_id", "part", "grp", "seq")], grams], names=["doc_id", "part", "grp", "seq", "grams"])

    seeds = replacements.select("doc_id", F.col("ord").cast("int").alias("ord"), "original").mapInArrow(sown, "doc_id long, ord int, seed string")
    kinds = [F.col(c).cast(k).alias(c) for c, k in (("doc_id", "long"), ("part", "string"), ("grp", "int"), ("seq", "int"))]
    grams = paragraphs.select(*kinds, "runs").mapInArrow(grown, "doc_id long, part string, grp int, seq int, grams array<string>")
    grams = grams.select("doc_id", F.explode("grams").alias("seed"), F.struct("part", "grp", "seq").alias("paragraph"))
    met = seeds.join(grams.hint("merge"), ["doc_id", "seed"], "left")
    return met.groupBy("doc_id", "ord").agg(F.bool_and(F.col("seed").isNotNull()).alias("seeded"), F.collect_set("paragraph").alias("near"))


def rebuild_documents(paragraphs: DataFrame, replacements: DataFrame, direct: int = 1_000_000) -> DataFrame:
    """Rows (doc_id, part, grp, seq, text, applied, failed) after substitution.

    ``paragraphs`` (doc_id, part, grp, seq, runs), ``replacements`` (doc_id, ord, original, placeholder). A document
    with its replacements is one row for the fold, which is sequential; many documents share a batch. Replacements can come as a list
    for each document (doc_id, given), in their order, too. These rows are stored, so what they are made of is worked once. Where a document
    has more than ``direct`` pairs of a paragraph and a replacement, Spark finds those that can match before
    (``candidate_pairs``), and the fold tries no others. Joins are merges: texts of many like
    documents compress so well that Spark would take them for a table small enough to send to all.
    """
    if "given" in replacements.columns:
        given = replacements.select("doc_id", F.transform("given", lambda r: F.struct(r["ord"].cast("int").alias("ord"), r["original"], r["placeholder"])).alias("given"))
    else:
        pair = F.struct(F.col("ord").cast("int").alias("ord"), "original", "placeholder")
        given = replacements.groupBy("doc_id").agg(F.sort_array(F.collect_list(pair)).alias("given"))
    own = paragraphs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "grp", "seq", "runs"))).alias("own"))
    rows = stored(own.join(given.hint("merge"), "doc_id", "left").withColumn("n", F.size("own").cast("long") * F.coalesce(F.size("given"), F.lit(0))), "documents")
    large = rows.filter(F.col("n") > direct)
    if large.isEmpty():
        rows = rows.withColumn("pairs", F.lit(None).cast(f"array<struct<ord:int,near:array<{_PARAGRAPH}>>>"))
    else:
        pairs = candidate_pairs(large.select("doc_id", F.inline("own")), large.select("doc_id", F.inline("given"))).filter("seeded")
        rows = rows.join(pairs.groupBy("doc_id").agg(F.collect_list(F.struct("ord", "near")).alias("pairs")).hint("merge"), "doc_id", "left")

    def run(batches):
        for b in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for doc, rows, given_, pairs in zip(*(objects(b.column(c)) for c in ("doc_id", "own", "given", "pairs"))):
                own_, given_, near = [(part, grp, seq, runs or []) for part, grp, seq, runs in rows], given_ or [], None
                if pairs:
                    at, place = {p[:3]: k for k, p in enumerate(own_)}, {ord_: k for k, (ord_, *_) in enumerate(given_)}
                    near = {place[ord_]: {at[p] for p in some} for ord_, some in pairs}
                runs, applied, failed = rebuild(own_, [(original, new) for _, original, new in given_], near)
                for (part, grp, seq, _), new in zip(own_, runs):
                    for column, x in zip(out, (doc, part, grp, seq, "".join(new), applied, failed)):
                        column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds)], names=[x.split(" ")[0] for x in _SCHEMA.split(", ")])

    # The fold reads all but the number of pairs.
    rows = rows.select("doc_id", "own", "given", "pairs")
    return rows.mapInArrow(run, _SCHEMA)


_OWN, _GIVEN = "array<struct<part:string,grp:int,seq:int,runs:array<string>>>", "array<struct<ord:int,original:string,placeholder:string>>"


def rebuild_found(docs: DataFrame, patterns=PATTERNS, direct: int = 1_000_000) -> DataFrame:
    """``rebuild_documents`` of rows (doc_id, own, found), with what patterns find (``hits.found_in``), reconciled, as replacements.

    ``own`` are paragraphs (part, grp, seq, runs); rows of one document are one. A document is reconciled and folded in one go and the
    result is stored, so nothing is worked twice; one with more than ``direct`` pairs is reconciled only, its fold is that
    of ``rebuild_documents``. Detections of rows without an id belong to no document.
    """
    made = hits.maker(patterns)
    text = pa.string()
    own_type = pa.list_(pa.struct([("part", text), ("grp", pa.int32()), ("seq", pa.int32()), ("runs", pa.list_(text))]))
    given_type = pa.list_(pa.struct([("ord", pa.int32()), ("original", text), ("placeholder", text)]))
    kinds = (pa.int64(), text, pa.int32(), pa.int32(), text, pa.int32(), pa.list_(text), own_type, given_type)
    names = [*[c.split(" ")[0] for c in _SCHEMA.split(", ")], "own", "given"]
    order = lambda p: [(x is not None, x) for x in p]

    def run(batches):
        def rows():
            for doc, every in hits.by_document(batches, ["own", "found"]):
                own = sorted([p for some, _ in every for p in some or ()], key=order)
                given = [] if doc is None else [(h[3], h[4]) for h in hits.reconciled([h for _, found in every for h in made(found)])]
                if len(own) * len(given) > direct:
                    yield doc, None, None, None, None, None, None, own, [(k + 1, *x) for k, x in enumerate(given)]
                    continue
                runs, applied, failed = rebuild([(part, grp, seq, runs or []) for part, grp, seq, runs in own], given)
                for (part, grp, seq, _), new in zip(own, runs):
                    yield doc, part, grp, seq, "".join(new), applied, failed, None, None

        yield from gathered(rows(), kinds, names)

    rows = stored(hits.sorted_by_document(docs.select("doc_id", F.col("own").cast(_OWN).alias("own"), "found")).mapInArrow(run, f"{_SCHEMA}, own {_OWN}, given {_GIVEN}"), "rebuilt")
    small, large = rows.filter("given is null").select(names[:7]), rows.filter("given is not null")
    if large.isEmpty():
        return small
    return small.unionByName(rebuild_documents(large.select("doc_id", F.inline("own")), large.select("doc_id", "given"), direct))
