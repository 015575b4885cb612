"""WARC archives: writing pages with revisit records, and verified reading.

Writing: one record per page. Pages with equal payloads of at least
``least_bytes`` bytes share one response, that of the largest page_id; the
others become revisit records without a body. Only pages whose payload digest
may be shared (a bitmap of fixed size says so) pass through the join that finds
the response; all others are written straight from the scan.

Reading verifies the chain of boundaries. Archives are split at the record
magic by Spark's text reader, so a file is read by many tasks. Each task parses
every piece as a candidate record and emits its offset and its successor's; a
magic inside a payload yields a candidate too. Inside a task's split the
successors are followed at once, which leaves one jump per candidate out of the
split; pointer jumping over these from the start of each file then finds where
the true chain enters each split, and only records on that chain are returned.
A task holds the body of one record at a time: that of the chain which begins
with its first candidate. Candidates inside that record are offsets only; those
that the true chain reaches all the same, as those cut by the end of a split,
are put together afterwards. So memory is bounded by the longest record, however
many magics its payload holds.

Defined cases: null html is an empty payload; a null url is left out; rows that
repeat the largest page_id of a payload are all responses; a null page_id stays
null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bits import bitmap, hit
from corvane.ship import ship
from .store import new_folder, stored

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
LEAST_BYTES = 1000
#: bytes of a file whose pieces and records are put together by one key
STRETCH = 16 << 20
CANDIDATE = (
    "file string, block bigint, rel bigint, size bigint, succ bigint, leaves bigint, page_id bigint, record_type string,"
    " refers_to bigint, payload_bytes bigint, payload_digest string, done boolean, payload binary"
)


def digests(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))


def _key(digest):
    return F.xxhash64(digest)


def with_response(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with ``response``: the page_id whose record they revisit, or their own."""
    rows = digests(pages)
    shared = rows.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response"))
    shared = stored(shared.where("n > 1").select("digest", "response"), "shared_payloads")
    marks = pages.sparkSession.sparkContext.broadcast(bitmap(shared, _key(F.col("digest"))))
    rows = rows.withColumn("maybe", hit(marks, _key(F.col("digest"))) & (F.col("n_bytes") >= least_bytes))
    own = rows.where(~F.col("maybe")).withColumn("response", F.col("page_id"))
    other = rows.where("maybe").join(shared, "digest", "left").withColumn("response", F.coalesce("response", "page_id"))
    return own.unionByName(other).drop("maybe")


def write_archive(pages: DataFrame, path: str, *, least_bytes: int = LEAST_BYTES) -> None:
    ship(pages.sparkSession)
    rows = with_response(pages, least_bytes)
    again = ~F.col("response").eqNullSafe(F.col("page_id"))
    nl = F.lit("\r\n")
    # an octet that would end a header line is written as its escape
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))

    def line(name, value):
        return F.coalesce(F.concat(F.lit(name + ": "), value, nl), F.lit(""))

    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:sha1:"), F.sha1(F.concat_ws("|", "page_id", "url", "digest")), F.lit(">"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("X-Refers-To-Page", F.when(again, F.col("response").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block), F.lit("\r\n\r\n"), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END.decode()).text(path)


class Split:
    """Candidates of one task's part of one file, in the order of the file."""

    def __init__(self, file: str, block: int, want_payload: bool):
        self.file, self.block, self.want = file, block, want_payload
        self.at = 0
        self.rows: list[dict] = []
        self.open: dict | None = None

    def add(self, piece: bytes) -> None:
        start, first = self.at - len(MAGIC), self.block == 0 and self.at == 0
        nested = self.open is not None
        if nested:
            self._feed(self.open, MAGIC)
            self._feed(self.open, piece)
            if self.open["missing"] <= 0:
                self.open = None
        self.at += len(piece) + len(MAGIC)
        row = {"rel": start, "size": len(piece) + len(MAGIC), "succ": None}
        self.rows.append(row)
        head = piece.find(END)
        if first or head < 0:
            return
        fields = {}
        for x in piece[:head].split(b"\r\n"):
            name, colon, value = x.partition(b":")
            if colon:
                fields[name.strip().lower()] = value.strip()
        length = fields.get(b"content-length", b"")
        if b"warc-type" not in fields or not length.isdigit():
            return
        row["succ"] = start + len(MAGIC) + head + len(END) + int(length) + len(END)
        row["record_type"] = fields[b"warc-type"].decode("latin-1")
        row["page_id"] = _number(fields.get(b"x-page-id"))
        row["refers_to"] = _number(fields.get(b"x-refers-to-page"))
        row["header_digest"] = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
        if nested:
            return
        row |= {"missing": int(length), "body": []}
        self._feed(row, piece[head + len(END) :])
        if row["missing"] > 0:
            self.open = row

    @staticmethod
    def _feed(row: dict, part: bytes) -> None:
        if "body" not in row:
            return
        part = part[: row["missing"]]
        row["missing"] -= len(part)
        row["body"].append(part)
        if row["missing"] == 0:
            finish(row)

    def done(self) -> list[dict]:
        """Close the split: follow successors inside it."""
        at = {r["rel"]: r for r in self.rows if r["succ"] is not None}
        for r in reversed(self.rows):
            if r["succ"] is not None:
                later = at.get(r["succ"]) if r["succ"] > r["rel"] else None
                r["leaves"] = later["leaves"] if later else r["succ"]
        return [r | {"file": self.file, "block": self.block, "done": r.get("missing") == 0} for r in self.rows]


def finish(row: dict) -> None:
    body = b"".join(row.pop("body"))
    head, _, payload = body.partition(END)
    if row["record_type"] == "revisit":
        said = [x for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
        row["payload_bytes"] = _number(said[0].partition(b":")[2].strip()) if said else 0
        row["payload_digest"], row["payload"] = row["header_digest"], None
    else:
        row["payload_bytes"], row["payload"] = len(payload), payload
        row["payload_digest"] = hashlib.sha1(payload).hexdigest()


def _number(x: bytes | None) -> int | None:
    return int(x) if x and x.lstrip(b"-").isdigit() else None


def _table(rows: list[dict], schema: pa.Schema, payload: bool) -> pa.RecordBatch:
    rows = [r if payload else {k: v for k, v in r.items() if k != "payload"} for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between record magics, in the order of the file inside each split."""
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def candidates(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind: StructType = _parse_datatype_string(CANDIDATE)

    def run(batches):
        schema, split = to_arrow_schema(kind), None
        for batch in batches:
            for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if split is None or (split.file, split.block) != (file, block):
                    if split:
                        yield _table(split.done(), schema, payload)
                    split = Split(file, block, payload)
                split.add(value)
        if split:
            yield _table(split.done(), schema, payload)

    return pieces(spark, path).mapInArrow(run, kind)


def read_archive(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """Records on the verified chain: page_id, record_type, refers_to, payload_bytes, payload_digest, payload."""
    ship(spark)
    cand = stored(candidates(spark, path, payload), "candidates")
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = cand.groupBy("file", "block").agg(F.sum("size").alias("n"))
    base = stored(base.select("file", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base")), "bases")
    links = cand.where("succ is not null").select("file", "block", "rel", "leaves").join(base, ["file", "block"])
    links = links.select("file", "block", "rel", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("leaves")).alias("nxt"))

    # pointer jumping from the start of each file, over the jumps that leave a split
    starts = base.select("file", F.lit(0).cast("long").alias("at")).distinct()
    ends = links.select("file", F.col("nxt").alias("at")).distinct().union(starts).distinct()
    jump = stored(links.join(ends, ["file", "at"], "left_semi").select("file", "at", "nxt"), "jumps")
    reached = stored(jump.join(starts, ["file", "at"], "left_semi").select("file", "at"), "reached")
    n, before = reached.count(), -1
    while n > before:
        new = reached.join(jump, ["file", "at"]).select("file", F.col("nxt").alias("at"))
        new = new.join(jump, ["file", "at"], "left_semi")
        reached = stored(reached.union(new).distinct(), "reached")
        far = jump.select("file", F.col("at").alias("nxt"), F.col("nxt").alias("far"))
        jump = stored(jump.join(far, ["file", "nxt"]).select("file", "at", F.col("far").alias("nxt")).union(jump.join(far, ["file", "nxt"], "left_anti").select("file", "at", "nxt")), "jumps")
        n, before = reached.count(), n

    entries = links.join(reached, ["file", "at"], "left_semi").select("file", "block", F.col("rel").alias("entry"))
    slim = cand.where("succ is not null").select("file", "block", "rel", "succ").join(entries, ["file", "block"])

    def walk(pdf):
        succ = dict(zip(pdf["rel"].tolist(), pdf["succ"].tolist()))
        at, on = int(pdf["entry"].iloc[0]), set()
        while at in succ and at not in on:
            on.add(at)
            at = succ[at]
        return pdf.loc[pdf["rel"].isin(on), ["file", "block", "rel"]]

    chain = slim.groupBy("file", "block").applyInPandas(walk, "file string, block bigint, rel bigint")
    records = cand.join(chain, ["file", "block", "rel"], "left_semi")
    out = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    split_up = stored(records.where("not done").join(base, ["file", "block"]).select("file", (F.col("base") + F.col("rel")).alias("at"), (F.col("succ") - F.col("rel")).alias("length")), "split_up")
    done = records.where("done").select(*out)
    return done.union(_gather(spark, path, base, split_up, payload).select(*out)) if split_up.head() else done


def _gather(spark, path, base, split_up, payload, stretch_bytes: int = STRETCH) -> DataFrame:
    """Records with a magic in the payload that run over the end of a split: put their pieces together."""

    def place(batches):
        at, now = 0, None
        for b in batches:
            rel = []
            for file, block, value in zip(*(b.column(i).to_pylist() for i in range(3))):
                if now != (file, block):
                    at, now = 0, (file, block)
                rel.append(at - len(MAGIC))
                at += len(value) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rel, pa.int64())], names=["file", "block", "value", "rel"])

    # pieces and records meet by stretches of the file, so a large file is no join on one key
    def stretch(x):
        return F.floor(x / F.lit(stretch_bytes))

    placed = pieces(spark, path).mapInArrow(place, "file string, block bigint, value binary, rel bigint")
    placed = placed.join(base, ["file", "block"]).select("file", "value", (F.col("base") + F.col("rel")).alias("from"))
    placed = placed.withColumn("stretch", stretch(F.col("from")))
    wanted = split_up.withColumn("stretch", F.explode(F.sequence(stretch(F.col("at")), stretch(F.col("at") + F.col("length")))))
    parts = placed.join(wanted, ["file", "stretch"]).where("`from` >= at and `from` < at + length").drop("stretch")

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("from")
        split = Split("", 1, payload)
        for value in pdf["value"]:
            split.add(bytes(value))
        r = split.rows[0]
        names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        one = pd.DataFrame({k: [r.get(k)] for k in names})
        if not payload:
            one["payload"] = None
        return one.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return parts.groupBy("file", "at").applyInPandas(build, "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def op10_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
