"""Documents and runs in a folder of parquet datasets.

``docs/v=<ticket>/o=<op>/_base=…/_day=…``   documents of one write, of any number of datasets
``runs/run=<ticket>/op=<n>/doc_day=…``      patch records of one run
``commits/<n>.json``                        what changed, one file per change

A commit says in one file all that a change does: documents added to datasets, datasets created, emptied or
dropped, days rewritten, the records of a run, views, how far a stream has come. Readers see what commits name, so
a change is seen whole or not at all, whatever a writer left behind. A commit is written aside and renamed to the
next number, which only one writer can take. Every ``_WHOLE``-th commit holds the state that all before it add up to.

Tickets order writes and runs. A row is as old as the ticket and operation that wrote it; a patch or a delete of a
document counts for rows older than itself, so a document that is created again after a delete is a new one.
A run that fails or has nothing to write is given up; what a crashed driver left open, ``give_up`` ends.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lanternlog.model import AUDIT_DDL, TS, document_ddl
from lanternlog.operators.patches import BORN, apply_patches, born
from lanternlog.operators.views import DETECTIONS, Catalog

_NO_DAY = "__HIVE_DEFAULT_PARTITION__"
_WHOLE = 64
_EMPTY: dict[str, Any] = {"ticket": 0, "bases": {}, "runs": [], "given_up": [], "views": {}, "streams": {}, "tallies": {}}

#: Part of a version: dataset, ticket, operation and days.
Part = tuple[str, int, int, list[str]]


def advance(state: dict[str, Any], change: dict[str, Any]) -> dict[str, Any]:
    """The state after a change. ``bases`` maps a dataset to how far runs are folded into it and its parts."""
    out = {**state, "bases": {b: {**d, "parts": [list(p) for p in d["parts"]]} for b, d in state["bases"].items()}}
    bases = out["bases"]
    out["ticket"] = max(state["ticket"], change.get("ticket", 0))
    # what runs before a dataset's beginning changed is no concern of its rows
    begin = change.get("ticket", state["ticket"] + 1) - 1
    for base in change.get("drop", ()):
        bases.pop(base, None)
    for base in change.get("create", ()):
        bases.setdefault(base, {"folded": begin, "parts": []})
    for base in change.get("reset", ()):
        bases[base] = {"folded": begin, "parts": []}
    if fold := change.get("fold"):
        data, gone = bases[fold["base"]], set(fold["days"])
        replaced = {(t, o) for t, o in fold["of"]}
        kept = [[t, o, [d for d in days if (t, o) not in replaced or d not in gone]] for t, o, days in data["parts"]]
        bases[fold["base"]] = {"folded": fold["upto"], "parts": [p for p in kept if p[2]]}
    for base, ticket, op, days in change.get("add", ()):
        bases.setdefault(base, {"folded": begin, "parts": []})["parts"].append([ticket, op, days])
    if run := change.get("run"):
        out["runs"] = [*state["runs"], run]
    if "given_up" in change:
        out["given_up"] = sorted({*state["given_up"], *change["given_up"]})
    if "views" in change:
        out["views"] = change["views"]
    if "tallied" in change:
        named = {f"{base}/{t}/{o}": change["folder"] for base, t, o in change["tallied"]}
        out["tallies"] = {**state.get("tallies", {}), **named}
    if stream := change.get("stream"):
        out["streams"] = {**state["streams"], stream[0]: stream[1]}
    return out


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._seen, self._state = 0, _EMPTY
        self._last_ticket = 0

    # files -------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path))

    def _text(self, path: str) -> str | None:
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _created(self, path: str, text: str) -> bool:
        """Write a file whole under a name nobody has; false where somebody has."""
        aside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(aside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        never = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
        context = jvm.FileContext.getFileContext(self._path(path).toUri(), self._conf)
        source, target = (context.makeQualified(self._path(p)) for p in (aside, path))
        try:
            context.rename(source, target, never)
        except Py4JJavaError as error:
            self._fs.delete(self._path(aside), False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True

    # commits -----------------------------------------------------------------------------

    def _commit_file(self, n: int) -> str:
        return f"{self.root}/commits/{n:012d}.json"

    def _now(self) -> dict[str, Any]:
        """The state of all commits; only those since the last look are read."""
        if not self._seen:
            numbers = [int(n[:-5]) for n in self._names(f"{self.root}/commits") if n.endswith(".json") and n[0] != "."]
            whole = max((n for n in numbers if n % _WHOLE == 0), default=0)
            if whole:
                self._seen, self._state = whole, json.loads(self._text(self._commit_file(whole)))["state"]
        while (text := self._text(self._commit_file(self._seen + 1))) is not None:
            self._state = advance(self._state, json.loads(text))
            self._seen += 1
        return self._state

    def _commit(self, change: dict[str, Any], once: tuple[str, int] | None = None) -> bool:
        """Publish a change in one step. With ``once`` (stream, batch) a batch that is published already is not again."""
        if once is not None:
            change = {**change, "stream": list(once)}
        while True:
            state = self._now()
            if once is not None and state["streams"].get(once[0], -1) >= once[1]:
                return False
            n = self._seen + 1
            text = {**change, "state": advance(state, change)} if n % _WHOLE == 0 else change
            if self._created(self._commit_file(n), json.dumps(text)):
                return True

    def _ticket(self) -> int:
        """The next number of a write or run, taken by nobody else."""
        if not self._last_ticket:
            taken = [int(n) for n in self._names(f"{self.root}/tickets") if n.isdigit()]
            self._last_ticket = max([self._now()["ticket"], *taken])
        while True:
            self._last_ticket += 1
            if self._created(f"{self.root}/tickets/{self._last_ticket}", ""):
                return self._last_ticket

    # documents ------------------------------------------------------------------------------

    def bases(self) -> list[str]:
        return sorted(self._now()["bases"])

    def _known(self, base: str) -> dict[str, Any]:
        try:
            return self._now()["bases"][base]
        except KeyError:
            raise LookupError(f"no dataset {base!r}") from None

    def create(self, base: str) -> None:
        if base in self.bases():
            raise ValueError(f"dataset {base!r} exists")
        self._commit({"create": [base]})

    def write(self, docs: DataFrame, base: str, mode: str = "append", once: tuple[str, int] | None = None) -> bool:
        """Dated sink. ``replace`` hides exactly this dataset's earlier documents."""
        return self.write_many(docs.withColumn("_base", F.lit(base)), mode, [base], once)

    def write_many(
        self, docs: DataFrame, mode: str = "append", bases: Sequence[str] | None = None, once: tuple[str, int] | None = None
    ) -> bool:
        """Write documents of many datasets, named by a column ``_base``, in one job and one commit.

        ``bases`` are datasets that exist afterwards even without rows. A batch of a stream (``once``) that was
        published before is not written again.
        """
        if mode not in ("append", "replace"):
            raise ValueError("mode is append or replace")
        if once is not None and self._now()["streams"].get(once[0], -1) >= once[1]:
            return False
        ticket = self._ticket()
        parts = self.put(docs, ticket)
        named = sorted({*(bases or ()), *(p[0] for p in parts)})
        reset = named if mode == "replace" else []
        return self._commit({"ticket": ticket, "create": named, "reset": reset, "add": parts}, once)

    def publish(self, parts: Sequence[Part], create: Sequence[str] = (), once: tuple[str, int] | None = None) -> bool:
        """Make parts that ``put`` wrote visible, all in one step; false where the batch ``once`` was published before."""
        newest = max((t for _, t, _, _ in parts), default=self._now()["ticket"])
        return self._commit({"ticket": newest, "create": list(create), "add": list(parts)}, once)

    def ticket(self) -> int:
        """A number for a write of one's own, to be published."""
        return self._ticket()

    def put(self, docs: DataFrame, ticket: int, op: int = 0) -> list[Part]:
        """Write documents with their ``_base``; nobody sees them until a commit adds the parts returned."""
        extra = [BORN] if BORN in docs.columns else []
        folder = f"{self.root}/docs/v={ticket}/o={op}"
        rows = docs.select("_base", *self._columns(), *extra)
        rows.hint("rebalance", F.col("_base"), F.col("_day")).write.mode("append").partitionBy("_base", "_day").parquet(folder)
        named = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        out: list[Part] = []
        for name in self._names(folder):
            if name.startswith("_base="):
                days = [d[5:] for d in self._names(f"{folder}/{name}") if d.startswith("_day=")]
                out.append((named(name[6:]), ticket, op, days))
        return out

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], document_ddl()).columns

    def days(self, base: str) -> list[str]:
        """The days a dataset has documents of."""
        return sorted({d for _, _, days in self._known(base)["parts"] for d in days})

    def stored(
        self,
        base: str,
        extra: Iterable[Part] = (),
        fresh: bool = False,
        newer: int | None = None,
        only: Iterable[str] | None = None,
    ) -> DataFrame:
        """Documents as written, before any patch that is not folded in, with their age (``BORN``). One scan.

        ``extra`` adds parts of an open run; ``fresh`` leaves out what the dataset held before that run dropped it;
        ``newer`` leaves out parts up to a ticket, ``only`` all but some days.
        """
        parts = [] if fresh else [tuple(p) for p in self._known(base)["parts"] if newer is None or p[0] > newer]
        parts += [(t, o, days) for b, t, o, days in extra if b == base]
        if only is not None:
            parts = [p for p in ((t, o, [d for d in days if d in set(only)]) for t, o, days in parts) if p[2]]
        columns = self._columns()
        if not parts:
            empty = self.spark.createDataFrame([], document_ddl())
            return empty.select(*columns, born(F.lit(0), F.lit(0)).alias(BORN))
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(base)
        folders = [f"{self.root}/docs/v={t}/o={o}/_base={escaped}/_day={d}" for t, o, days in parts for d in days]
        ddl = f"{document_ddl()}, {BORN} struct<run_seq:bigint,op_seq:bigint>, v bigint, o bigint"
        frame = self.spark.read.schema(ddl).option("basePath", f"{self.root}/docs").parquet(*folders)
        return frame.select(*columns, F.coalesce(BORN, born(F.col("v"), F.col("o"))).alias(BORN))

    def read(
        self, base: str, extra: Iterable[Part] = (), own: Iterable[tuple[int, int, list[str]]] = (), fresh: bool = False
    ) -> DataFrame:
        """Current documents. Days no pending patch touches are read without any join.

        ``extra`` and ``own`` are the parts and the records of an open run.
        """
        return self._current(base, extra, own, fresh).drop(BORN)

    def _current(
        self,
        base: str,
        extra: Iterable[Part] = (),
        own: Iterable[tuple[int, int, list[str]]] = (),
        fresh: bool = False,
        upto: int | None = None,
        newer: int | None = None,
        only: Sequence[str] | None = None,
    ) -> DataFrame:
        extra = list(extra)
        docs = self.stored(base, extra, fresh, newer, only)
        present = {d for b, _, _, days in extra if b == base for d in days} | (set() if fresh else set(self.days(base)))
        present &= present if only is None else set(only)
        earlier = [] if fresh else self._records_after(self._known(base)["folded"], upto)
        pending = [p for p in [*earlier, *own] if present & set(p[2])]
        touched = sorted(present & {d for _, _, days in pending for d in days})
        if not touched:
            return docs
        log = self.records([(t, o, [d for d in days if d in present]) for t, o, days in pending])
        mine = log.where(F.col("index").rlike(rf"^{base}-\d{{4}}\.\d{{2}}\.\d{{2}}$"))
        if set(touched) == present:
            return apply_patches(docs, mine)
        hit = _on_days("_day", touched)
        return docs.where(~hit).unionByName(apply_patches(docs.where(hit), mine))

    def tallies(self, base: str) -> DataFrame:
        """``_day, event_dataset, docs, first, last, sources``: counts, times and a sketch of source addresses.

        Written once for each part, since parts never change, and merged when asked for; only parts that nobody has
        asked about yet and days with records that are not folded in are read. ``sources`` merges with
        ``hll_union_agg`` and is estimated by ``hll_sketch_estimate``.
        """
        state, known = self._now(), self._known(base)
        parts = [tuple(p) for p in known["parts"]]
        done = state.get("tallies", {})
        new = [(base, t, o, days) for t, o, days in parts if f"{base}/{t}/{o}" not in done]
        if new:
            # all days of the new parts as they were written, whichever of them are still to be seen
            written = self.stored(base, new, fresh=True).select(*self._columns(), BORN)
            folder = f"tallies/{uuid.uuid4().hex}"
            at = F.input_file_name()
            place = [F.regexp_extract(at, f"/{k}=(\\d+)/", 1).cast("bigint").alias(k) for k in ("v", "o")]
            _tallied(written, place).withColumn("base", F.lit(base)).write.parquet(f"{self.root}/{folder}")
            self._commit({"tallied": [[b, t, o] for b, t, o, _ in new], "folder": folder})
            done = self._now()["tallies"]
        pending = self.pending_days(base)
        seen = [(t, o, d) for t, o, days in parts for d in days if d not in pending]
        patched = _tallied(self._current(base, only=pending), [])
        folders = sorted({f"{self.root}/{done[f'{base}/{t}/{o}']}" for t, o, _ in parts})
        if not seen:
            return _merged(patched)
        spark = self.spark
        visible = spark.createDataFrame(seen, "v bigint, o bigint, d string")
        visible = visible.select("v", "o", F.when(F.col("d") != _NO_DAY, F.col("d")).cast("date").alias("d"))
        rows = spark.read.parquet(*folders).where(F.col("base") == base)
        same = (rows["v"] == visible["v"]) & (rows["o"] == visible["o"]) & rows["_day"].eqNullSafe(visible["d"])
        kept = rows.join(visible, same, "left_semi").select(*patched.columns)
        return _merged(kept.unionByName(patched) if pending else kept)

    def catalog(self) -> Catalog:
        out = Catalog(views=self._views(), saved=self._save_views)
        for base in self.bases():
            out.register(
                base,
                lambda b=base: self.read(b),
                lambda b=base: [f"{b}-{d.replace('-', '.')}" for d in self.days(b)],
            )
        return out

    # runs --------------------------------------------------------------------------------------

    def runs(self) -> list[dict[str, Any]]:
        """Notes of the committed runs in order: ``ticket``, ``run_id``, ``parts`` (operation, days) and their summary."""
        return sorted(self._now()["runs"], key=lambda r: r["ticket"])

    def _settled(self) -> int:
        """The last ticket such that no run up to it is open."""
        state = self._now()
        over = {r["ticket"] for r in state["runs"]} | set(state["given_up"])
        started = [int(n[4:]) for n in self._names(f"{self.root}/runs")]
        first_open = min((s for s in started if s not in over), default=None)
        return state["ticket"] if first_open is None else first_open - 1

    def begin_run(self) -> int:
        ticket = self._ticket()
        self._fs.mkdirs(self._path(f"{self.root}/runs/run={ticket}"))
        return ticket

    def append_op(self, records: DataFrame, ticket: int, op_seq: int) -> tuple[int, int, list[str]]:
        """Write one operation of an open run, split by document day for later pruning."""
        target = f"{self.root}/runs/run={ticket}/op={op_seq}"
        by_day(records, "doc_day").write.mode("overwrite").partitionBy("doc_day").parquet(target)
        return ticket, op_seq, [n[8:] for n in self._names(target) if n.startswith("doc_day=")]

    def commit_run(
        self,
        ticket: int,
        records: Sequence[tuple[int, int, list[str]]],
        note: dict[str, Any],
        add: Sequence[Part] = (),
        create: Sequence[str] = (),
        drop: Sequence[str] = (),
    ) -> None:
        """All a run did, in one step: datasets dropped and created, documents added, records."""
        run = {**note, "ticket": ticket, "parts": [[op, days] for _, op, days in records if days]}
        self._commit({"ticket": ticket, "drop": list(drop), "create": list(create), "add": list(add), "run": run})

    def give_up(self, *tickets: int) -> list[int]:
        """End runs that will not commit; without tickets all that are open, for use when no writer is at work."""
        state = self._now()
        over = {r["ticket"] for r in state["runs"]} | set(state["given_up"])
        wanted = tickets or tuple(int(n[4:]) for n in self._names(f"{self.root}/runs"))
        ended = sorted({t for t in wanted if t not in over})
        if ended:
            self._commit({"ticket": max(ended), "given_up": ended})
        return ended

    def _records_after(self, folded: int, upto: int | None = None) -> list[tuple[int, int, list[str]]]:
        return [
            (r["ticket"], op, days)
            for r in self.runs()
            if r["ticket"] > folded and (upto is None or r["ticket"] <= upto)
            for op, days in r["parts"]
        ]

    def log(self) -> DataFrame:
        """Records of all committed runs."""
        return self.records(self._records_after(0))

    def log_of(self, run_id: str) -> DataFrame:
        """What a rollback of a run has to know: its own records, and those of later runs on the days it touched."""
        mine = [r for r in self.runs() if r["run_id"] == run_id]
        if not mine:
            return self.records([])
        first = min(r["ticket"] for r in mine)
        days = {d for r in mine for _, ds in r["parts"] for d in ds}
        later = [(t, op, [d for d in ds if d in days]) for t, op, ds in self._records_after(first - 1)]
        return self.records([p for p in later if p[2]])

    def records(self, parts: Iterable[tuple[int, int, list[str]]]) -> DataFrame:
        """Records of operations (ticket, operation, days) in one scan of just those days."""
        columns = self.spark.createDataFrame([], AUDIT_DDL)
        folders = [f"{self.root}/runs/run={t}/op={op}/doc_day={d}" for t, op, days in parts for d in days]
        if not folders:
            return columns
        found = self.spark.read.schema(AUDIT_DDL).option("basePath", f"{self.root}/runs").parquet(*folders)
        return found.select(*columns.columns)

    def pending_days(self, base: str) -> list[str]:
        """Days of a dataset that records not yet folded in concern."""
        present = set(self.days(base))
        return sorted({d for _, _, days in self._records_after(self._known(base)["folded"]) for d in days if d in present})

    def compact(self, base: str, everything: bool = False) -> int:
        """Fold the pending patches of a dataset into new files of the touched days (of all days: ``everything``).

        What an open run writes stays pending, and so do runs that follow it. Rows keep their age.
        """
        known = self._known(base)
        upto = max(self._settled(), known["folded"])
        touched = {d for _, _, days in self._records_after(known["folded"], upto) for d in days}
        days = [d for d in self.days(base) if everything or d in touched]
        ticket = self._ticket()
        of = [(t, o) for t, o, _ in known["parts"]]
        current = self._current(base, upto=upto).withColumn("_base", F.lit(base))
        parts = self.put(current.where(_on_days("_day", days)), ticket) if days else []
        fold = {"base": base, "days": days, "of": of, "upto": upto}
        self._commit({"ticket": ticket, "fold": fold, "add": parts})
        return len(days)

    def reset(self, *bases: str) -> None:
        """Hide all documents of datasets; used before a replay."""
        self._commit({"reset": list(bases)})

    def reset_replay(self, bases: Sequence[str], checkpoint: str | None = None) -> None:
        """Before a replay: hide the events and the detections made of them, and forget a stream's progress."""
        known = self.bases()
        self.reset(*[base for base in dict.fromkeys([*bases, DETECTIONS]) if base in known])
        if checkpoint:
            path = self._path(checkpoint)
            path.getFileSystem(self._conf).delete(path, True)

    def progress(self, stream: str) -> int | None:
        """The last batch that a stream has committed."""
        return self._now()["streams"].get(stream)

    def has_newer(self, base: str, after: int) -> bool:
        """Whether a dataset got parts after a ticket."""
        return any(t > after for t, _, _ in self._known(base)["parts"])

    def since(self, base: str, after: int | None) -> tuple[DataFrame, int]:
        """Current documents written after a ticket (None: all), and the ticket up to which they are complete.

        Only parts written since are read. Rows that a compaction wrote anew are as old as they were.
        """
        upto = self._settled()
        docs = self._current(base, newer=after).where(F.col(BORN)["run_seq"] <= upto)
        if after is not None:
            docs = docs.where(F.col(BORN)["run_seq"] > after)
        return docs.drop(BORN), upto

    # views ------------------------------------------------------------------------------------

    def _views(self) -> dict[str, list]:
        return {k: [tuple(s) for s in v] for k, v in self._now()["views"].items()}

    def _save_views(self, views: dict[str, list]) -> None:
        self._commit({"views": views})


def _tallied(docs: DataFrame, place: list[Column]) -> DataFrame:
    return docs.groupBy(*place, "_day", "event_dataset").agg(
        F.count(F.lit(1)).alias("docs"),
        F.min(TS).alias("first"),
        F.max(TS).alias("last"),
        F.hll_sketch_agg("source_ip").alias("sources"),
    )


def _merged(tallies: DataFrame) -> DataFrame:
    return tallies.groupBy("_day", "event_dataset").agg(
        F.sum("docs").alias("docs"), F.min("first").alias("first"), F.max("last").alias("last"), F.hll_union_agg("sources").alias("sources")
    )


def _on_days(column: str, days: Sequence[str]) -> Column:
    """The day is one of ``days`` (folder names); never null, so its negation holds for rows without a day."""
    dated = F.col(column).isin([F.lit(d).cast("date") for d in days if d != _NO_DAY])
    return F.coalesce(dated, F.lit(_NO_DAY in days))


def by_day(df: DataFrame, day: str) -> DataFrame:
    """Bring the rows of a day together before a write, in pieces of the advisory size.

    Without it every task writes a file for every day it holds. Adaptive execution splits
    a day that is larger than a piece and merges small ones.
    """
    return df.hint("rebalance", F.col(day))
