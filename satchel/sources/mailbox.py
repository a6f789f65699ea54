"""A mailbox as a Spark data source, in batch and as a stream.

Offline mailboxes are folders of message files, ``<root>/<folder>/<uid>.eml``, or an archive, a Parquet table of messages
partitioned by folder; with a ``host`` the mail server is read. The driver lists UIDs only; tasks open the messages, ``batch``
of a folder each. UIDs are compared again after listing, as mail servers answer a range that starts after the last message
with that message.

``searched()`` reads with pushed filters: conditions on folder, uid and internal_date decide which folders are opened and
become the server's search (``SINCE``, ``UID n:m``), so that what does not fit is neither listed nor fetched.

The stream's offset is the last UID of each folder, kept in the checkpoint. A trigger lists what comes after the last offset
and takes at most ``admit`` messages of a folder.
"""

from __future__ import annotations

import imaplib
import importlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from email import message_from_bytes, policy
from email.utils import getaddresses, parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "folder string, uid long, raw binary, flags array<string>, internal_date long"
Message = tuple[int, bytes, list[str] | None, int | None]


@dataclass
class Bounds:
    """What is looked for in a folder: UIDs over ``after`` and up to ``upto``, arrived at ``since`` (milliseconds) or later."""

    after: int = 0
    upto: int | None = None
    since: int | None = None

    def holds(self, uid: int) -> bool:
        return self.after < uid and (self.upto is None or uid <= self.upto)

    def search(self) -> str:
        """The search of a mail server. Servers compare days, in a zone of their own, so that a day more is asked for."""
        found = []
        if self.since is not None:
            day = datetime.fromtimestamp(self.since / 1000, timezone.utc) - timedelta(days=1)
            month = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")[day.month - 1]
            found.append(f"SINCE {day.day:02d}-{month}-{day.year:04d}")
        if self.after or self.upto is not None or not found:
            found.append(f"UID {self.after + 1}:{'*' if self.upto is None else self.upto}")
        return " ".join(found)


class Files:
    """Folders of message files."""

    def __init__(self, options):
        self.root = options["path"]

    def folders(self) -> list[str]:
        return sorted(n for n in os.listdir(self.root) if os.path.isdir(os.path.join(self.root, n)))

    def uids(self, folder: str, bounds: Bounds) -> list[int]:
        names = (n[:-4] for n in os.listdir(os.path.join(self.root, folder)) if n.endswith(".eml"))
        return [int(n) for n in names if n.isdigit()]

    def messages(self, folder: str, uids: list[int]) -> Iterator[Message]:
        for uid in uids:
            with open(os.path.join(self.root, folder, f"{uid}.eml"), "rb") as f:
                yield uid, f.read(), None, None


class Archive:
    """A Parquet table of messages (uid, raw, flags, internal_date) in ``folder=<name>`` directories, as archive() writes it."""

    def __init__(self, options):
        import pyarrow.dataset as ds

        path = re.sub("^file:/*", "/", options["archive"])
        kinds = pa.schema([("folder", pa.string())])
        self.table = ds.dataset(path, format="parquet", partitioning=ds.partitioning(kinds, flavor="hive"))

    def folders(self) -> list[str]:
        import pyarrow.dataset as ds

        names = {ds.get_partition_keys(f.partition_expression).get("folder") for f in self.table.get_fragments()}
        return sorted(n for n in names if n is not None)

    def uids(self, folder: str, bounds: Bounds) -> list[int]:
        import pyarrow.dataset as ds

        fits = (ds.field("folder") == folder) & (ds.field("uid") > bounds.after)
        if bounds.upto is not None:
            fits &= ds.field("uid") <= bounds.upto
        if bounds.since is not None:
            fits &= ds.field("internal_date") >= bounds.since
        return self.table.to_table(["uid"], filter=fits).column("uid").to_pylist()

    def messages(self, folder: str, uids: list[int]) -> Iterator[Message]:
        import pyarrow.dataset as ds

        fits = (ds.field("folder") == folder) & (ds.field("uid") >= uids[0]) & (ds.field("uid") <= uids[-1]) & ds.field("uid").isin(uids)
        for batch in self.table.to_batches(["uid", "raw", "flags", "internal_date"], filter=fits):
            yield from zip(*(c.to_pylist() for c in batch.columns))


def archive(messages: DataFrame, path: str) -> None:
    """Writes messages (folder, uid, raw, and maybe flags and internal_date) as a mailbox archive, each folder sorted by UID."""
    there = set(messages.columns)
    columns = [F.col(c) if c in there else F.lit(None).cast(kind).alias(c) for c, kind in (x.strip().split(" ") for x in SCHEMA.split(", "))]
    messages.select(*columns).repartitionByRange("folder", "uid").sortWithinPartitions("folder", "uid").write.partitionBy("folder").parquet(path)


class Server:
    """A mail server, read without changing flags: options host, port, user, and password or token (XOAUTH2)."""

    LISTED = re.compile(rb'\((?P<flags>[^)]*)\) (?:"[^"]*"|NIL) "?(?P<name>[^"]*)"?')

    def __init__(self, options):
        self.connection = self.connect(options)
        if "token" in options:
            self.connection.authenticate("XOAUTH2", lambda _: f"user={options['user']}\x01auth=Bearer {options['token']}\x01\x01".encode())
        else:
            self.connection.login(options["user"], options["password"])
        self.selected = None

    def connect(self, options):
        return imaplib.IMAP4_SSL(options["host"], int(options.get("port", 993)), timeout=60)

    def folders(self) -> list[str]:
        found = (self.LISTED.match(x) for x in self.connection.list()[1] if x)
        return sorted(m["name"].decode() for m in found if m and b"\\Noselect" not in m["flags"])

    def _select(self, folder: str) -> None:
        if folder != self.selected:
            if self.connection.select(f'"{folder}"', readonly=True)[0] != "OK":
                raise OSError(f"cannot open the folder {folder}")
            self.selected = folder

    def uids(self, folder: str, bounds: Bounds) -> list[int]:
        self._select(folder)
        found = self.connection.uid("SEARCH", bounds.search())[1]
        return [int(x) for part in found if part for x in part.split()]

    def messages(self, folder: str, uids: list[int]) -> Iterator[Message]:
        """All in one request. A message that has gone since it was listed is left out."""
        self._select(folder)
        found = self.connection.uid("FETCH", ",".join(map(str, uids)), "(UID FLAGS INTERNALDATE BODY.PEEK[])")[1]
        for part, after in zip(found, [*found[1:], b""]):
            if isinstance(part, tuple):
                about = part[0] + (after if isinstance(after, bytes) else b"")  # some servers tell the rest behind the body
                stamp, uid = re.search(rb'INTERNALDATE "([^"]*)"', about), re.search(rb"\bUID (\d+)", about)
                if uid is None:
                    raise OSError(f"a message of {folder} came without its number")
                yield int(uid[1]), part[1], [x.decode() for x in imaplib.ParseFlags(about)], int(parsedate_to_datetime(stamp[1].decode()).timestamp()) * 1000 if stamp else None


def client(options) -> Files | Archive | Server:
    """The client of the options; ``client`` names another class as ``module:class``."""
    if "client" in options:
        module, name = options["client"].split(":")
        return getattr(importlib.import_module(module), name)(options)
    return Server(options) if "host" in options else Archive(options) if "archive" in options else Files(options)


class Slice(InputPartition):
    """Some messages of a folder."""

    def __init__(self, folder: str, uids: list[int]):
        self.folder, self.uids = folder, uids


class _Reader:
    def __init__(self, options):
        self.options, self.batch = options, int(options.get("batch", 50))
        self.only = set(options["folders"].split(",")) if "folders" in options else None

    def _listed(self, bounds) -> dict[str, list[int]]:
        """UIDs of each wanted folder in order; bounds: of a folder's name."""
        own, out = client(self.options), {}
        for folder in own.folders():
            if self.only is None or folder in self.only:
                b = bounds(folder)
                out[folder] = sorted(u for u in own.uids(folder, b) if b.holds(u)) if b is not None else []
        return out

    def _slices(self, listed: dict[str, list[int]]) -> list[Slice]:
        return [Slice(f, uids[i : i + self.batch]) for f, uids in listed.items() for i in range(0, len(uids), self.batch)]

    def read(self, part: Slice | None) -> Iterator[tuple]:
        """part: None where there are no partitions."""
        for uid, raw, flags, date in client(self.options).messages(part.folder, part.uids) if part else ():
            yield part.folder, uid, raw, flags, date


class MailReader(_Reader, DataSourceReader):
    """``since_uid`` bounds what is opened; ``limit`` takes so many messages of each folder, in order of UID."""

    def __init__(self, options):
        super().__init__(options)
        self.bounds = Bounds(int(options.get("since_uid", 0)))
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self):
        return self._slices({f: uids[: self.limit] for f, uids in self._listed(lambda _: self.bounds).items()})


class SearchReader(MailReader):
    """Takes conditions on folder and uid whole, and the least arrival, which Spark checks again in milliseconds."""

    def _narrowed(self, names: Iterable[str]) -> None:
        self.only = set(names) if self.only is None else self.only & set(names)

    def _between(self, least: int | None = None, most: int | None = None) -> None:
        if least is not None:
            self.bounds.after = max(self.bounds.after, least - 1)
        if most is not None:
            self.bounds.upto = most if self.bounds.upto is None else min(self.bounds.upto, most)

    def pushFilters(self, filters: list[S.Filter]) -> Iterable[S.Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else ""
            if isinstance(f, S.IsNotNull) and column in ("folder", "uid"):
                continue  # they always are
            if column == "folder" and isinstance(f, S.EqualTo):
                self._narrowed([f.value])
            elif column == "folder" and isinstance(f, S.In):
                self._narrowed(f.value)
            elif column == "uid" and isinstance(f, S.EqualTo):
                self._between(f.value, f.value)
            elif column == "uid" and isinstance(f, (S.GreaterThan, S.GreaterThanOrEqual)):
                self._between(least=f.value + isinstance(f, S.GreaterThan))
            elif column == "uid" and isinstance(f, (S.LessThan, S.LessThanOrEqual)):
                self._between(most=f.value - isinstance(f, S.LessThan))
            else:
                if column == "internal_date" and isinstance(f, (S.GreaterThan, S.GreaterThanOrEqual, S.EqualTo)):
                    self.bounds.since = max(self.bounds.since or 0, f.value)
                yield f

    def partitions(self):
        if self.bounds.upto is not None and self.bounds.upto <= self.bounds.after or self.only == set():
            return []
        return super().partitions()


class MailStream(_Reader, DataSourceStreamReader):
    """Messages in order of UID. ``resume``: the offset from which the checkpoint goes on, as JSON, so that the first trigger
    of a restarted stream need not list its folders whole."""

    def __init__(self, options):
        super().__init__(options)
        self.admit = int(options.get("admit", 1000))
        self.at: dict | None = json.loads(options["resume"]) if "resume" in options else None

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def latestOffset(self) -> dict:
        """Where it goes on is not known after a restart without ``resume``: then all that there is is taken."""
        at, most = self.at or {}, None if self.at is None else self.admit
        found = {f: uids[:most][-1] for f, uids in self._listed(lambda f: Bounds(at.get(f, 0))).items() if uids}
        return at | found

    def partitions(self, start: dict, end: dict):
        self.at = end
        return self._slices(self._listed(lambda f: Bounds(start.get(f, 0), end[f]) if end.get(f, 0) > start.get(f, 0) else None))


class Mailbox(DataSource):
    """``spark.read.format("mailbox").option("path", root)``; register with spark.dataSource.register(Mailbox)."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return MailReader(self.options)

    def streamReader(self, schema):
        return MailStream(self.options)


class SearchedMailbox(Mailbox):
    """The mailbox with pushed filters, which a session has to allow; see searched()."""

    @classmethod
    def name(cls) -> str:
        return "searched_mailbox"

    def reader(self, schema):
        return SearchReader(self.options)


def searched(spark: SparkSession, **options: str) -> DataFrame:
    """The messages of a mailbox; filters on folder, uid and internal_date reach it. From now on the session lets Python
    sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchedMailbox)
    return spark.read.format("searched_mailbox").options(**options).load()


PARSED = "folder string, uid long, message_id string, in_reply_to string, references array<string>, subject string, from_address string, from_name string, to_addresses array<struct<email:string,name:string>>, date_sent long, body_text string, body_html string, attachment_count int, size_bytes long, error string, flags array<string>, internal_date long, is_read boolean"


def _parse(folder: str, uid: int, raw: bytes) -> dict:
    out = {"folder": folder, "uid": uid, "size_bytes": len(raw), "from_address": "", "to_addresses": [], "attachment_count": 0}
    try:
        m = message_from_bytes(raw, policy=policy.default)
        senders = getaddresses(m.get_all("from", []))
        out["from_name"], out["from_address"] = senders[0] if senders else (None, "")
        out["to_addresses"] = [{"email": e, "name": n} for n, e in getaddresses(m.get_all("to", [])) if e]
        out["subject"], out["message_id"] = m["subject"], m["message-id"]
        named = {h: [x for x in re.findall(r"<[^<>\s]+>", str(m[h] or ""))] for h in ("in-reply-to", "references")}
        out["in_reply_to"], out["references"] = next(iter(named["in-reply-to"]), None), named["references"]
        out["date_sent"] = int(parsedate_to_datetime(m["date"]).timestamp()) * 1000 if m["date"] else None
        text, page = m.get_body(("plain",)), m.get_body(("html",))
        out["body_text"], out["body_html"] = (part.get_content() if part is not None else None for part in (text, page))
        out["attachment_count"] = sum(1 for _ in m.iter_attachments()) if m.is_multipart() else 0
        out["subject"] = out["subject"] and str(out["subject"])
    except Exception as error:  # a broken message is reported in its row; the others go on
        out["error"] = f"{type(error).__name__}: {error}"[:200]
    return out


def parsed(messages: DataFrame) -> DataFrame:
    """Messages of the mailbox with their headers and bodies; what cannot be parsed has ``error``. Flags and the date of arrival
    are null where a mailbox keeps none."""
    names = [c.split()[0] for c in PARSED.replace("struct<email:string,name:string>", "x").split(", ")]
    kinds = {"uid": pa.int64(), "date_sent": pa.int64(), "size_bytes": pa.int64(), "attachment_count": pa.int32(), "references": pa.list_(pa.string()), "to_addresses": pa.list_(pa.struct([("email", pa.string()), ("name", pa.string())]))}
    kinds |= {"flags": pa.list_(pa.string()), "internal_date": pa.int64(), "is_read": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                _parse(f, u, r or b"") | {"flags": flags, "internal_date": date, "is_read": None if flags is None else "\\Seen" in flags}
                for f, u, r, flags, date in zip(*(batch.column(c).to_pylist() for c in ("folder", "uid", "raw", "flags", "internal_date")))
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    return messages.select("folder", "uid", "raw", "flags", "internal_date").mapInArrow(run, PARSED)
