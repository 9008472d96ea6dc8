"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import table
from runloom.llm.html_text import blocks_of, text_of

# Fixed value: date of records whose source states none.
NO_DATE = "1970-01-01T00:00:00Z"
SHAPE = ("{key} {kind}, url string, record_type string, record_id string, refers_to string, concurrent_to string, "
         "block_digest string, payload_digest string, content_length long, source_headers string, content string, record binary")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: object) -> str:
    return " ".join(str(value).split())


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response_of(url: str | None, page: str | None, key: object, copy: int) -> tuple[str, list[tuple[str, object]], bytes, bytes, str, str]:
    """Identifier, header fields, block, payload and the digests of both of the response of one page row."""
    payload = (page or "").encode("utf-8", "replace")
    whole = digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}|{copy}|{url or str()}|{whole}')}>"
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", NO_DATE), ("WARC-Target-URI", url or None),
              ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", framed := digest(block)),
              ("WARC-Payload-Digest", whole)]
    return name, fields, block, payload, framed, whole


def derivatives(key: object, url: str | None, page: str | None, copy: int = 0) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    source, fields, block, payload, framed, whole = response_of(url, page, key, copy)
    headers = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n"
    blocks = blocks_of(page or "")
    text = text_of(blocks)
    facts = (f"source-payload-digest: {whole}\r\nsource-block-digest: {framed}\r\nsource-content-type: text/html\r\n"
             f"source-length: {len(payload)}\r\nblocks: {len(blocks)}\r\ntext-characters: {len(text)}\r\n")
    ids = {t: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, source + t)}>" for t in ("metadata", "conversion")}
    out = []
    for kind, mime, body in (("metadata", "application/warc-fields", facts), ("conversion", "text/plain; charset=utf-8", text)):
        data = body.encode("utf-8", "replace")
        other = ids["metadata"] if kind == "conversion" else None
        own = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", NO_DATE), ("WARC-Target-URI", url or None),
               ("WARC-Refers-To", source), ("WARC-Concurrent-To", other), ("Content-Type", mime), ("WARC-Block-Digest", own_digest := digest(data)),
               ("WARC-Source-Payload-Digest", whole)]
        out.append((key, url, kind, ids[kind], source, other, own_digest, whole, len(data), headers, body, record(own, data)))
    return out


def build_derivatives(pages: DataFrame) -> DataFrame:
    """Two records per row of pages (page_id, url, html): its metadata and its conversion.

    Identifiers are derived from page_id, url and payload, so a task that runs again makes the same
    records; rows repeated in full therefore share their identifiers. Null html is an empty payload,
    a null url leaves the target out; line breaks in a url become blanks; an empty table gives no
    rows; other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    shape = SHAPE.format(key="page_id", kind=kind)
    names = [c.strip().split(" ")[0] for c in shape.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for key, url, page in zip(batch["page_id"], batch["url"], batch["html"], strict=True) for r in derivatives(key, url, page)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "url", "html").mapInPandas(run, shape)


def write_warc(records: DataFrame, path: str) -> None:
    """Raw record bytes as Parquet parts under path.

    Each partition is sorted by page; a WARC file is the records of a part in order.
    """
    records.sortWithinPartitions("page_id", F.desc("record_type")).select("page_id", "record_id", "record").write.parquet(path)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return build_derivatives(table(spark, folder, "pages")).drop("record")
