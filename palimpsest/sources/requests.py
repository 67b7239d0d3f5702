"""What a job is asked to do and with which settings: mappings given as JSON, settings of the session, parsed documents with fallbacks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.model import Client, Limiter, Retrying, resolve_parsed
from palimpsest.sources import docx
from palimpsest.sources.batches import slices

# The files that a listing shows where there is no folder to list.
DEMO_FILES = (("Report.docx", 713_317), ("Annual Update.docx", 2_637_121))


@dataclass(frozen=True)
class Settings:
    """Settings of a job, read from the session's ``spark.palimpsest.*``."""

    folder: str = ""
    chunk_size: str = "max"
    attempts: int = 5
    requests_per_minute: int = 450
    tokens_per_minute: int = 81_000
    reply_tokens: int = 8192

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        got = {f.name: spark.conf.get(f"spark.palimpsest.{f.name}", None) for f in fields(cls)}
        return cls(**{f.name: type(f.default)(got[f.name]) for f in fields(cls) if got[f.name] is not None})

    def client(self, client: Client, workers: int = 1) -> Retrying:
        """A client that keeps to these settings, with its share of the allowance where ``workers`` ask at once."""
        share = Limiter(max(1, self.requests_per_minute // workers), max(1, self.tokens_per_minute // workers))
        return Retrying(client, attempts=self.attempts, most_tokens=self.reply_tokens, limiter=share)


def mapping_of(spark: SparkSession, request: str) -> DataFrame:
    """(ord, name, content) of a request's mapping, a JSON object, in its order; what is no object gives no row."""
    rows = spark.createDataFrame([(request,)], "request string")
    entries = F.map_entries(F.from_json("request", "map<string,string>"))
    return rows.select(F.posexplode(entries).alias("ord", "e")).select("ord", F.col("e.key").alias("name"), F.col("e.value").alias("content"))


def listing_or_demo(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, size, mock) of a folder's files; of the demonstration's where the folder can't be read."""
    try:
        found = docx.listing(spark, path).withColumn("mock", F.lit(False))
        found.limit(1).collect()
        return found
    except Exception:  # noqa: BLE001 - any reason not to list leads to the demonstration
        return spark.createDataFrame([(n, f"{path}{n}", s, True) for n, s in DEMO_FILES], "name string, path string, size long, mock boolean")


def parsed(files: DataFrame, parser: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, content, text, status, error) of files (path, content).

    ``parser`` gives a file's parsed form as JSON. Where it fails, gives nothing or what is no JSON with a text, the
    file is read here (status ``local``, with the parser's error); where that fails too, status is ``failed`` and text
    null. No text stands in for a file that can't be read.
    """

    def run(batches):
        for b in slices(batches):
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                given = error = None
                if parser is not None:
                    try:
                        given = parser(content) or None
                        error = None if given else "nothing parsed"
                    except Exception as e:  # noqa: BLE001 - told in the row
                        error = f"{type(e).__name__}: {e}"
                rows.append((path, content, given, error))
            kinds = (pa.string(), pa.binary(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, kinds)], names=["path", "content", "given", "error"])

    def read(batches):
        for b in slices(batches):
            texts, status, errors = [], [], []
            for content, given, error in zip(*(b.column(c).to_pylist() for c in ("content", "given", "error"))):
                state, text = "parsed", given
                if given is None:
                    try:
                        state, text = "local", "\n\n".join(e[1] for e in docx.parse(content, blanks=True) if e[2] in ("paragraph", "table_cell"))
                    except Exception as e:  # noqa: BLE001 - told in the row
                        state, text, error = "failed", None, f"{error}; {type(e).__name__}: {e}" if error else f"{type(e).__name__}: {e}"
                texts.append(text)
                status.append(state)
                errors.append(error)
            yield pa.record_batch([b.column("path"), b.column("content"), pa.array(texts, pa.string()), pa.array(status), pa.array(errors, pa.string())], names=["path", "content", "text", "status", "error"])

    asked = files.select("path", "content").mapInArrow(run, "path string, content binary, given string, error string")
    broken = F.col("given").isNotNull() & F.try_parse_json("given").isNull()
    asked = asked.withColumn("error", F.when(broken, "the parsed form is no JSON").otherwise(F.col("error"))).withColumn("given", F.when(F.col("given").isNotNull() & ~broken, resolve_parsed(F.col("given"))))
    return asked.mapInArrow(read, "path string, content binary, text string, status string, error string")
