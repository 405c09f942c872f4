"""Folders of mails, one file each, as a data source of its own: ``spark.read.format("mail_folder")``.

Reading lists the folder once, packs files into partitions of bounded size and parses MIME where the files
are read, so whole files never pass through the JVM. Writing makes one file per row under a name of task and
row, so a repeated task replaces its own files; what a failed job wrote is removed. Files are reached through
Arrow's file systems: local and mounted paths, and whatever ``scheme://`` Arrow knows.

Options: ``path``, ``kind`` (eml, txt or json; json only for writing), ``partition_bytes``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from email.header import Header
from email.mime.base import MIMEBase
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lurelens.sources import mail as M

PARTITION_BYTES = 32 << 20
#: What opening a file costs, in bytes: many small files still share a partition fairly.
OPEN_BYTES = 64 << 10
FILE_SCHEMA = f"path string, {M.PARSED}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class _Files(InputPartition):
    paths: list[str]


def packed(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Files in order, as few groups as keep each within the bound; a larger file stands alone."""
    groups, room = [], 0
    for path, size in sizes:
        cost = size + OPEN_BYTES
        if not groups or cost > room:
            groups.append([])
            room = most
        groups[-1].append(path)
        room -= cost
    return groups


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path, self.kind = schema, options["path"], options.get("kind", "eml")
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, root = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size or 0) for f in found if f.is_file and f.base_name.endswith("." + self.kind))
        return [_Files(paths) for paths in packed(files, self.most)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        shape = to_arrow_schema(self.schema)
        for path in partition.paths if partition else []:
            with system.open_input_stream(path) as file:
                yield pa.RecordBatch.from_pylist([{"path": path} | M.mail_or_error(file.read())], schema=shape)


def composed(row: Row) -> bytes:
    """The mail as a message with an exact body. A table knows names and sizes of attachments only, so their
    bytes are zeros."""
    text = MIMEText(row["body"] or "", "plain", "utf-8")
    message = text
    if row["attachments"]:
        message, inner = MIMEMultipart("mixed"), MIMEMultipart("alternative")
        inner.attach(text)
        message.attach(inner)
        for attachment in row["attachments"]:
            part = MIMEBase(*attachment["content_type"].split("/", 1))
            part.set_payload(bytes(attachment["size"]))
            part.add_header("Content-Disposition", "attachment", filename=attachment["filename"])
            message.attach(part)
    for name, column in (("Message-ID", "id"), ("Subject", "subject"), ("From", "from_email"), ("To", "to_email"), ("Reply-To", "reply_to")):
        value = row[column]
        if value is not None:
            message[name] = value if str(value).isascii() else Header(value, "utf-8", maxlinelen=1 << 20).encode()
    return message.as_bytes(policy=message.policy.clone(max_line_length=None))


def document(row: Row) -> bytes:
    names = {"from_email": "from", "to_email": "to"}
    return json.dumps({names.get(k, k): v for k, v in row.asDict(recursive=True).items()}, indent=1).encode()


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.kind = options["path"], options.get("kind", "eml")
        if self.kind not in ("eml", "txt", "json"):
            raise ValueError(f"unsupported format: {self.kind}")
        system, root = file_system(self.path)
        if overwrite:
            system.delete_dir_contents(root, missing_dir_ok=True)
        system.create_dir(root, recursive=True)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = file_system(self.path)
        make = document if self.kind == "json" else composed
        task, paths = TaskContext.get().partitionId(), []
        for number, row in enumerate(rows):
            paths.append(f"{root}/mail-{task:05d}-{number:07d}.{self.kind}")
            with system.open_output_stream(paths[-1]) as file:
                file.write(make(row))
        return _Written(paths)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = file_system(self.path)
        for message in messages:
            for path in message.paths if message else []:
                system.delete_file(path)


class MailFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mail_folder"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def read_folder(spark: SparkSession, path: str, kind: str = "eml") -> tuple[DataFrame, DataFrame]:
    """All mail files below a folder: (mails, quarantine)."""
    if kind not in ("eml", "txt"):
        raise ValueError(f"unsupported format: {kind}")
    spark.dataSource.register(MailFolder)
    return M.split_bad(M.mail_columns(spark.read.format("mail_folder").option("kind", kind).load(path), "path"))


def write_folder(mails: DataFrame, path: str, kind: str = "eml", mode: str = "overwrite") -> None:
    """One file per mail: id, subject, from_email, to_email, reply_to, body, attachments; json keeps all columns."""
    mails.sparkSession.dataSource.register(MailFolder)
    mails.write.format("mail_folder").option("kind", kind).mode(mode).save(path)
