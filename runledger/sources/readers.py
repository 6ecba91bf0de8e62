"""Reading the documents runs leave behind."""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of the documents, as their writers name them.
RECORD_SCHEMA = (
    "run_id string, path string, depth int, idx int, name string, kind string, returncode int, cached boolean, skipped boolean, "
    "backend string, image string, image_digest string, containerized boolean, venv string, venv_digest string, sandboxed boolean, "
    "inputs map<string,string>, outputs map<string,string>, resources map<string,string>, generated_at string"
)
RECORD_FIELDS = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
CACHE_SCHEMA = (
    "map<string,struct<cache_key:string,run_id:string,kind:string,backend:string,image:string,image_digest:string,containerized:boolean,"
    "venv:string,venv_digest:string,sandboxed:boolean,outputs:map<string,string>>>"
)
JOURNAL_SCHEMA = (
    "map<string,struct<dev:bigint,ino:bigint,ctime_ns:bigint,path:string,head:string,status:string,tainted_through:string,first:bigint,"
    "generations:array<struct<name:string,size:bigint,snapshot_present:boolean>>,"
    "marker:struct<step_path:string,field:string,cache_key:string,run_id:string,started_at:double>,consumed:map<string,string>>>"
)
SAMPLE_BYTES = 4096
BATCH_ROWS = 10_000


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (file, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _dealt(docs: DataFrame) -> DataFrame:
    """Documents over all cores: thousands of small ones come in one split, and walking them costs far more than moving them."""
    return docs.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, *docs.columns)


def _as_text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def rejected_json(docs: DataFrame, text: str = "text", schema: str | None = None) -> DataFrame:
    """The documents a JSON reader leaves out: other columns, and the reason.

    Readers go on without a bad document; this tells which those were.

    Args:
        schema: The shape the reader expects, such as `CACHE_SCHEMA`; by default any JSON object.
    """
    rest = [c for c in docs.columns if c != text]
    shaped = F.from_json(text, schema) if schema else F.from_json(text, "map<string,string>")
    reason = (
        F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", F.lit("empty"))
        .when(F.try_parse_json(text).isNull(), F.lit("not JSON"))
        .when(shaped.isNull(), F.lit("not of the expected shape"))
    )
    return docs.select(*rest, reason.alias("reason")).where("reason is not null")


def _object(text: str | None) -> dict | None:
    """A JSON object, or None for anything else."""
    try:
        value = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


TEXTS = ("name", "kind", "backend", "image", "image_digest", "venv", "venv_digest")
MAPS = ("inputs", "outputs", "resources")


def _record_fault(document: object) -> str | None:
    """What about a run document has not the expected shape, if anything."""
    if not isinstance(document, dict):
        return "not of the expected shape"
    if not isinstance(document.get("generated_at"), str | None):
        return "generated_at is no text"
    stack = [document.get("root", document)]
    while stack:
        record = stack.pop()
        if not isinstance(record, dict):
            return "a step is no object"
        code = record.get("returncode")
        if not (code is None or (isinstance(code, int) and abs(code) < 2**31)):
            return "returncode is no whole number"
        for name in TEXTS:
            if not isinstance(record.get(name), str | None):
                return f"{name} is no text"
        for name in MAPS:
            if not isinstance(record.get(name), dict | None):
                return f"{name} is no object"
        steps = record.get("steps")
        if not isinstance(steps, list | None):
            return "steps is no list"
        stack += reversed(steps or [])
    return None


def rejected_records(docs: DataFrame, text: str = "text", run: str = "run_id") -> DataFrame:
    """The run documents that `flatten_records` leaves out: (run_id, reason)."""

    def reason(body: str | None) -> str | None:
        if not (body or "").strip():
            return "empty"
        try:
            return _record_fault(json.loads(body))
        except (ValueError, RecursionError):
            return "not JSON"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            judged = [(key, reason(body)) for key, body in zip(frame["run_id"], frame["text"])]
            yield pd.DataFrame([j for j in judged if j[1] is not None], columns=["run_id", "reason"])

    return _dealt(docs.select(F.col(run).cast("string").alias("run_id"), F.col(text).alias("text"))).mapInPandas(batches, "run_id string, reason string")


def flatten_records(docs: DataFrame, text: str = "text", run: str = "run_id") -> DataFrame:
    """One row per step of each run document, at any depth, in pre-order.

    `path` is the dotted path below the root, `depth` 0 is the root. Fields an
    older document lacks come back as null, flags as false. What a document says
    of the run itself, such as `generated_at`, is in each of its rows. A document is
    walked where it is read, so nothing is shuffled or collected. One of another
    shape gives no rows; see `rejected_records`.
    """
    plain = [f for f in RECORD_FIELDS if f not in ("run_id", "path", "depth", "idx", "inputs", "outputs", "resources", "generated_at")]
    flags = {"cached", "skipped", "containerized", "sandboxed"}

    def walk(run_id: str, document: dict) -> Iterator[dict]:
        stack = [(document.get("root", document), "", 0)]
        idx = 0
        while stack:
            record, above, depth = stack.pop()
            path = record.get("name") if not above else f"{above}.{record.get('name')}"
            row = {n: bool(record.get(n)) if n in flags else record.get(n) for n in plain}
            maps = {n: {k: _as_text(v) for k, v in (record.get(n) or {}).items()} for n in MAPS}
            yield {"run_id": run_id, "path": path, "depth": depth, "idx": idx, **row, **maps, "generated_at": document.get("generated_at")}
            idx += 1
            stack += [(child, path, depth + 1) for child in reversed(record.get("steps") or [])]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            steps = (row for run_id, doc in zip(frame["run_id"], map(_object, frame["text"])) if doc is not None and _record_fault(doc) is None for row in walk(run_id, doc))
            for rows in batched(steps, BATCH_ROWS):
                yield pd.DataFrame(list(rows), columns=RECORD_FIELDS).astype({"returncode": "Int32"})

    return _dealt(docs.select(F.col(run).cast("string").alias("run_id"), F.col(text).alias("text"))).mapInPandas(batches, RECORD_SCHEMA)


def read_runs(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Run documents as flat step records.

    Args:
        per_line: Whether a file holds one document per line (as `write_runs`
            leaves them) rather than one in all. The run id is then the
            document's own; otherwise it is the file's path,
            which names one run only.
    """
    if per_line:
        docs = spark.read.text(path).select(F.get_json_object("value", "$.run_id").alias("run_id"), F.col("value").alias("text"))
    else:
        docs = documents(spark, path).select(F.col("file").alias("run_id"), "text")
    return flatten_records(docs)


def parse_cache(docs: DataFrame, text: str = "text") -> DataFrame:
    """Entries of cache documents, `{step_path: {...}}`: other columns, step_path, and the entry's fields."""
    rest = [c for c in docs.columns if c != text]
    table = F.from_json(text, CACHE_SCHEMA)
    return docs.select(*rest, F.explode(table).alias("step_path", "e")).select(*rest, "step_path", "e.*")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cache documents under `path` as entries with their file."""
    return parse_cache(documents(spark, path))


def parse_chains(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chain journals, `{chain: {...}}`, as (chains, generations, consumed).

    A consumed key is `step_path::field`. A chain too long for one document goes
    on in others, whose `first` is the position their generations begin at; the
    chain itself and what it consumed are told by the one without it.
    """
    rest = [c for c in docs.columns if c != text]
    table = F.from_json(text, JOURNAL_SCHEMA)
    rows = docs.select(*rest, F.explode(table).alias("chain", "c"))
    heads = rows.where(F.coalesce("c.first", F.lit(0)) == 0)
    chains = heads.select(
        *rest, "chain", "c.dev", "c.ino", "c.ctime_ns", "c.path", "c.head", F.coalesce("c.status", F.lit("trusted")).alias("status"), "c.tainted_through",
        F.col("c.marker.step_path").alias("marker_step"), F.col("c.marker.field").alias("marker_field"), F.col("c.marker.cache_key").alias("marker_key"), F.col("c.marker.run_id").alias("marker_run"),
    )
    begins = F.coalesce("c.first", F.lit(0)).alias("__first")
    generations = rows.select(*rest, "chain", begins, F.posexplode("c.generations").alias("pos", "g")).select(
        *rest, "chain", (F.col("pos") + F.col("__first")).alias("pos"), "g.name", F.coalesce("g.size", F.lit(0)).alias("size"), F.coalesce("g.snapshot_present", F.lit(True)).alias("present")
    )
    consumed = heads.select(*rest, "chain", F.explode("c.consumed").alias("k", "name")).select(
        *rest, "chain", F.substring_index("k", "::", 1).alias("step_path"), F.substring_index("k", "::", -1).alias("field"), "name"
    )
    return chains, generations, consumed


def read_chains(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chain journals under `path` as (chains, generations, consumed)."""
    return parse_chains(documents(spark, path))


def scan_files(spark: SparkSession, root: str, sample: bool = False) -> DataFrame:
    """Files under a root: (path, mtime_ms, size[, sample, error]).

    Only metadata is listed unless `sample` asks for a digest of the first and
    last 4 KiB, which tasks read by seeking, whatever a file's size; the store
    must then be one that `pyarrow.fs` opens. A file without a sample has the
    error, `missing` or `unreadable`. Empty files hold no rows for Spark to scan
    and are not listed; `walk_files` sees them too.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    meta = listed.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))
    if not sample:
        return meta

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [sample_of(path, size) for path, size in zip(frame["path"], frame["size"])]
            yield frame.assign(sample=[s for s, _ in found], error=[e for _, e in found])

    return meta.mapInPandas(batches, "path string, mtime_ms bigint, size bigint, sample string, error string")


def sample_of(path: str, size: int) -> tuple[str | None, str | None]:
    """Digest of the first and last 4 KiB of a file, read without the rest; or why there is none."""
    from pyarrow import fs

    try:
        if path.startswith(("file:", "/")):
            store, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            store, name = fs.FileSystem.from_uri(path)
        with store.open_input_file(name) as f:
            head = f.read(SAMPLE_BYTES)
            f.seek(min(size, max(size - SAMPLE_BYTES, SAMPLE_BYTES)))
            return hashlib.sha256(head + f.read(SAMPLE_BYTES)).hexdigest(), None
    except FileNotFoundError:
        return None, "missing"
    except (OSError, ValueError, ImportError):
        return None, "unreadable"


PARAM_SCHEMA = "task string, base string, binary string, description string, parameters array<variant>"


def parse_param_docs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Parameters of classic JSON documents: (other columns, task, image, command, flavour, pos, name, dtype, required, default_json, mapping, choices_json, info).

    The first of several dtypes counts, and `io: msfile` overrides it.
    """
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(*rest, F.from_json(text, PARAM_SCHEMA).alias("d")).select(*rest, "d.*")
    params = rows.select(
        *rest,
        F.col("task"),
        F.nullif(F.col("base"), F.lit("")).alias("image"),
        F.coalesce("binary", "task").alias("command"),
        F.when(F.coalesce("base", F.lit("")).contains("casa"), F.lit("casa-task")).otherwise(F.lit("binary")).alias("flavour"),
        F.posexplode("parameters").alias("pos", "p"),
    )

    def field(name: str, kind: str = "string") -> Column:
        return F.try_variant_get("p", f"$.{name}", kind)

    first = F.coalesce(F.try_variant_get("p", "$.dtype[0]", "string"), F.when(~field("dtype").startswith("["), field("dtype")), F.lit("str"))
    name = field("name")
    return params.select(
        *rest, "task", "image", "command", "flavour", "pos",
        name.alias("name"),
        F.when(field("io") == "msfile", F.lit("MS")).otherwise(first).alias("dtype"),
        F.coalesce(field("required", "boolean"), F.lit(False)).alias("required"),
        F.to_json(field("default", "variant")).alias("default_json"),
        field("mapping").alias("mapping"),
        F.to_json(field("choices", "variant")).alias("choices_json"),
        field("info").alias("info"),
    )


def read_param_docs(spark: SparkSession, path: str) -> DataFrame:
    """Classic JSON parameter documents under `path`."""
    return parse_param_docs(documents(spark, path))


LEAF_SCHEMA = "doc string, path string, value string"


def parse_yaml(docs: DataFrame, doc: str = "file", text: str = "text") -> DataFrame:
    """YAML documents in long form (doc, path, value), one row per leaf.

    Lists are leaves, as JSON; those under a directive (`_use`, `_include`) are
    joined by commas, files of a package each with its name. An empty map is the leaf `{}`. Dates and times are ISO
    text, binary values base64. A document that cannot be read, whatever the
    reason, gives no rows; see `rejected_yaml`.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = ((name, *leaf) for name, body in zip(frame["doc"], frame["text"]) for leaf in _yaml(body)[0])
            for rows in batched(found, BATCH_ROWS):
                yield pd.DataFrame(rows, columns=["doc", "path", "value"])

    return _dealt(docs.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text"))).mapInPandas(batches, LEAF_SCHEMA)


def _yaml(text: str | None) -> tuple[list[tuple[str, str | None]], str | None]:
    """The leaves (path, value) of a document and None, or nothing and why it cannot be read."""
    import yaml

    try:
        return list(_leaves(yaml.load(text or "", getattr(yaml, "CSafeLoader", yaml.SafeLoader)), "")), None
    except yaml.YAMLError as error:
        return [], f"not YAML: {getattr(error, 'problem', None) or 'unreadable'}"
    except RecursionError:
        return [], "holds itself"
    except (ValueError, TypeError, ArithmeticError) as error:
        return [], f"a value cannot be read: {error}"


def _leaves(node: object, path: str) -> Iterator[tuple[str, str | None]]:
    if path.rsplit(".", 1)[-1] == "_include" and isinstance(node, dict | list):
        yield path, ",".join(_entries(node))
    elif isinstance(node, dict) and node:
        for key, value in node.items():
            yield from _leaves(value, f"{path}.{_key(key)}" if path else _key(key))
    elif isinstance(node, list) and path.rsplit(".", 1)[-1] in ("_use", "_include"):
        yield path, ",".join(map(str, node))
    else:
        yield path, _as_text(_plain(node))


def _entries(node: object) -> Iterator[str]:
    """The entries of an include; `{(package): [file, ...]}` is `(package)file` for each."""
    for entry in node if isinstance(node, list) else [node]:
        if isinstance(entry, dict):
            for package, files in entry.items():
                yield from (f"{package}{file}" for file in (files if isinstance(files, list) else [files]))
        else:
            yield str(entry)


def _key(key: object) -> str:
    return key if isinstance(key, str) else str(_plain(key))


def _plain(value: object) -> object:
    """A value of a document with nothing that JSON lacks."""
    if isinstance(value, dict):
        return {_key(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    if isinstance(value, set):
        return sorted(map(_plain, value), key=repr)
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    return value.isoformat() if isinstance(value, datetime.date | datetime.time) else value


def rejected_yaml(docs: DataFrame, doc: str = "file", text: str = "text") -> DataFrame:
    """The documents `parse_yaml` leaves out: (doc, reason)."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            judged = [(name, _yaml(body)[1]) for name, body in zip(frame["doc"], frame["text"])]
            yield pd.DataFrame([j for j in judged if j[1] is not None], columns=["doc", "reason"])

    return _dealt(docs.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text"))).mapInPandas(batches, "doc string, reason string")


def read_param_yaml(spark: SparkSession, path: str) -> DataFrame:
    """YAML documents under `path` in long form."""
    return parse_yaml(documents(spark, path))


def read_accounting(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated accounting rows: (job_id, state, exit_code)."""
    return spark.read.csv(path, sep="|", schema="job_id string, state string, exit_code string")
