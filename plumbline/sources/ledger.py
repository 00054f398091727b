"""A hash-chained, append-only record of runs, baselines, epochs and verdicts.

Writing is done by the driver for the few records of one append, and any number of writers may append: each puts
its records as one file under the next sequence number, if no other has. Reading and verifying is parallel: a line's own hash needs only that line, and its link is an equi-join with the line before.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENESIS = hashlib.sha256(b"plumbline-ledger-genesis-1").hexdigest()
SCHEMA = "seq long, type string, prev string, semantics_version int, schema int, payload string, hash string"
TYPES = ["run", "baseline", "rebaseline", "verdict"]
RUN_FIELDS = {"run_id", "run_index", "kind", "suite_hash", "judge_pin", "anchor_pin", "epoch", "observations", "stream_id"}
OBSERVATION_FIELDS = {"item", "score", "raw"}


def canonical(value) -> str:
    """Sorted keys, no insignificant white space."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def item_key(item_id: str) -> str:
    """What the ledger stores of an item: 128 bits of its hash, never the id."""
    return hashlib.sha256(f"plumbline-item-1:{item_id}".encode()).hexdigest()[:32]


def allowed(payload: dict) -> dict:
    extra = set(payload) - RUN_FIELDS | {k for o in payload.get("observations", []) for k in set(o) - OBSERVATION_FIELDS}
    if extra:
        raise ValueError(f"fields that a ledger may not hold: {', '.join(sorted(extra))}")
    return payload


def seal(seq: int, kind: str, prev: str, payload: str, semantics: int = 1, schema: int = 1) -> str:
    """The record's hash, over a text that Spark can put together alike."""
    return hashlib.sha256("\n".join([str(seq), kind, prev, str(semantics), str(schema), payload]).encode()).hexdigest()


def chained(records: list[tuple[str, str]], head: tuple[int, str] = (-1, GENESIS)) -> list[tuple]:
    """Records (type, payload text) as chained rows after head (seq, hash)."""
    seq, prev = head
    rows = []
    for kind, payload in records:
        if kind not in TYPES:
            raise ValueError(f"unknown record type {kind}")
        seq += 1
        rows.append((seq, kind, prev, 1, 1, payload, seal(seq, kind, prev, payload)))
        prev = rows[-1][-1]
    return rows


def chain(spark: SparkSession, records: list[tuple[str, str]], head: tuple[int, str] = (-1, GENESIS)) -> DataFrame:
    return spark.createDataFrame(chained(records, head), SCHEMA)


def verify(lines: DataFrame) -> DataFrame:
    """lines with hash_ok, link_ok, seq_ok (its seq is its own, and 0 or one after another line's), one ledger at a time."""
    own = F.sha2(F.concat_ws("\n", "seq", "type", "prev", "semantics_version", "schema", "payload"), 256)
    heads = lines.groupBy("seq").agg(F.min("hash").alias("head"), F.count(F.lit(1)).alias("times"))
    same = heads.select("seq", (F.col("times") == 1).alias("single"))
    before = heads.select((F.col("seq") + 1).alias("seq"), "head", (F.col("times") == 1).alias("before"))
    rows = lines.join(same, "seq", "left").join(before, "seq", "left")
    first = F.col("seq") == 0
    link = F.col("prev") == F.when(first, GENESIS).otherwise(F.col("head"))
    whole = F.coalesce(F.col("single") & (first | F.col("before")), F.lit(False))
    return rows.select(*lines.columns, (own == F.col("hash")).alias("hash_ok"), F.coalesce(link, F.lit(False)).alias("link_ok"), whole.alias("seq_ok"))


def put_if_absent(spark: SparkSession, path: str, name: str, text: str) -> bool:
    """Puts a whole file at path/name, visible at once; False, and nothing changed, if there is one already.

    Of writers that try the same name, one succeeds: on a local file system by a hard link, elsewhere by a rename that
    doesn't overwrite, which is atomic where renames are (HDFS).
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    fs.mkdirs(root)
    hidden = f".{name}-{uuid.uuid4().hex}"
    if fs.getUri().getScheme() == "file":
        local = root.toUri().getPath()
        with open(f"{local}/{hidden}", "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(f"{local}/{hidden}", f"{local}/{name}")
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{local}/{hidden}")
        return True
    at, to = jvm.org.apache.hadoop.fs.Path(root, hidden), jvm.org.apache.hadoop.fs.Path(root, name)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(at, to, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(at, False)
        return False
    return True


Records = list[tuple[str, str]]


def append(spark: SparkSession, path: str, records: Records | Callable[[DataFrame | None], Records], attempts: int = 50) -> DataFrame:
    """Verify what is there, then add records in one file, whoever else is writing.

    The file is named by its first record's seq and put only if no file has that name. A writer that comes second reads
    the ledger again and tries behind the new head, so no record is lost or doubled. records: a list, or a function of
    the lines read (None: no ledger yet) that makes it anew for every attempt.
    """
    for _ in range(attempts):
        try:
            have = read(spark, path)
            head = have.agg(F.max(F.struct("seq", "hash")).alias("h")).first()["h"]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have, head = None, None
        if have is not None and verify(have).where("not (hash_ok and link_ok and seq_ok)").take(1):
            raise ValueError(f"the ledger at {path} is damaged; nothing was added")
        rows = chained(records(have) if callable(records) else records, (head["seq"], head["hash"]) if head else (-1, GENESIS))
        if not rows:
            return spark.createDataFrame([], SCHEMA)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        text = "".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows)
        if put_if_absent(spark, path, f"{rows[0][0]:020d}.json", text):
            return spark.createDataFrame(rows, SCHEMA)
        time.sleep(random.random() * 0.05)
    raise TimeoutError(f"{attempts} attempts to append to {path} were overtaken by other writers")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def run_payload(run: dict) -> str:
    """A run projected to what may be stored: scores, hashes and metadata."""
    rows = [{"item": item_key(o["item_id"]), "score": o["score"], "raw": o.get("raw")} for o in run["observations"]]
    return canonical(allowed({k: v for k, v in run.items() if k != "observations"} | {"observations": rows}))


def rebaseline_payload(reason: str) -> str:
    if not reason.strip():
        raise ValueError("a rebaseline needs a reason")
    return canonical({"reason": reason.strip()})


RUN = "struct<stream_id:string,run_id:string,run_index:bigint,kind:string,epoch:int,suite_hash:string,judge_pin:struct<provider:string,model:string,rubric_hash:string,params_hash:string,scale:string>,observations:array<struct<item:string,score:double,raw:double>>>"


def runs(lines: DataFrame, kind: str | None = None) -> DataFrame:
    """Typed runs out of the ledger."""
    out = lines.where("type = 'run'").select("seq", F.from_json("payload", RUN).alias("r")).select("seq", "r.*")
    return out if kind is None else out.where(F.col("kind") == kind)


def observations(lines: DataFrame) -> DataFrame:
    """The long form that plans read."""
    return runs(lines).select("stream_id", "kind", "epoch", "run_index", F.explode("observations").alias("o")).select("stream_id", "kind", "epoch", "run_index", F.col("o.item").alias("item_id"), "o.score", "o.raw")


def verdicts(lines: DataFrame) -> DataFrame:
    return lines.where("type = 'verdict'").select("seq", "semantics_version", F.from_json("payload", "struct<stream_id:string,at:bigint,verdict:string,rule_id:string,alpha:double,target:double>").alias("v")).select("seq", "semantics_version", "v.*")


def epoch(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count_if(F.col("type") == "rebaseline").alias("epoch"))


def current_pins(lines: DataFrame) -> DataFrame:
    """The latest baseline or rebaseline payload, else the earliest run's."""
    return lines.agg(F.coalesce(F.max_by("payload", F.when(F.col("type").isin("baseline", "rebaseline"), F.col("seq"))), F.min_by("payload", F.when(F.col("type") == "run", F.col("seq")))).alias("payload"))
