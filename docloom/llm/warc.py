"""WARC derivatives: linked metadata and plain-text conversion records made from response records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
#: Elements whose content is not shown, and comments; each is left by its own end.
HIDING = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
ENDS = {None: re.compile("-->"), **{x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template")}}
BLOCKS = re.compile(r"</?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|br|blockquote|pre|title|head|body)\b[^>]*>", re.I)
TAG, TITLE, TITLE_END = re.compile(r"<[^>]*>"), re.compile(r"<title[^>]*>", re.I), re.compile(r"</title", re.I)
ANCHOR, HREF = re.compile(r"<a\b", re.I), re.compile(r"\bhref\s*=\s*", re.I)
VALUE = re.compile(r"""\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+|["'][^\s>]*))""")
BLANK = re.compile(r"[ \t\r\f\v]+")
#: Source headers that a derivative carries on.
CARRIED = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same for the same source, so a repeated task writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record; line breaks in a header value become spaces."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers.items() if v is not None]
    lines += [f"WARC-Block-Digest: {sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


class Headers(dict):
    """Header fields with their names as written; they are found whatever their case."""

    def __init__(self, lines: list[str]):
        super().__init__((name.strip(), value.strip()) for name, _, value in (line.partition(":") for line in lines) if name.strip())
        self.names = {name.lower(): name for name in reversed(list(self))}

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(self.names.get(name.lower(), name))

    def __contains__(self, name) -> bool:
        return name.lower() in self.names

    def get(self, name: str, default=None):
        return self[name] if name in self else default


def parsed(data: bytes) -> tuple[Headers, bytes]:
    """Headers and block of one record. Bytes that are none raise ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = Headers(lines[1:])
    size = headers.get("Content-Length", "")
    if not size.isdigit():
        raise ValueError("a record without a length")
    return headers, rest[: int(size)]


def unchunked(body: bytes) -> bytes:
    """The content of a chunked body, as far as it is whole."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        digits = body[at:end].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", digits) or not (size := int(digits, 16)):
            break
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(parts)


def content(http: Headers, body: bytes, most: int = 1 << 28) -> bytes:
    """A body without transfer and content encoding; what cannot be unpacked stays as it is, what grows beyond ``most`` is refused."""
    if "chunked" in http.get("Transfer-Encoding", "").lower():
        body = unchunked(body)
    kind = http.get("Content-Encoding", "").strip().lower()
    if kind in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):  # with a header of gzip or zlib, or bare
            unpack = zlib.decompressobj(bits)
            try:
                plain = unpack.decompress(body, most)
            except zlib.error:
                continue
            if unpack.unconsumed_tail:
                raise ValueError("a packed body is too large")
            return plain
    return body


def response(url: str, page: str, key: str) -> bytes:
    payload = page.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = {
        "WARC-Type": "response", "WARC-Record-ID": record_id("response", url, key), "WARC-Date": DATE, "WARC-Target-URI": url,
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": sha1(payload),
    }
    return record(headers, block)


def shown(page: str) -> str:
    """The page with a blank for each hidden element and comment; one that does not end hides the rest.

    The scan goes from a beginning to its end and on from there, so every character is looked at a fixed number of times.
    """
    parts, at = [], 0
    while (found := HIDING.search(page, at)) is not None:
        parts.append(page[at : found.start()])
        end = ENDS[found[1] and found[1].lower()].search(page, found.end())
        if end is None:
            return " ".join([*parts, ""])
        at = end.end()
    return " ".join([*parts, page[at:]])


def tagged(page: str) -> tuple[str, str]:
    """The page up to its last ``>`` and the rest: before it every ``<`` finds an end, after it none does."""
    cut = page.rfind(">") + 1
    return page[:cut], page[cut:]


def plain_text(page: str) -> str:
    """Visible text, one line for each block; entities are decoded after tags have gone."""
    inside, rest = tagged(shown(page))
    text = TAG.sub("", BLOCKS.sub("\n", inside)) + rest
    lines = (BLANK.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def page_title(page: str) -> str | None:
    """Content of the first title element that ends."""
    begin = TITLE.search(tagged(page)[0])
    end = begin and TITLE_END.search(page, begin.end())
    return page[begin.end() : end.start()] if end else None


def page_links(page: str) -> list[str]:
    """The first address of every link, in text order."""
    found, at = [], 0
    while (anchor := ANCHOR.search(page, at)) is not None:
        at = anchor.end()
        stop = page.find(">", at)
        stop = len(page) if stop < 0 else stop
        value = None
        while value is None and (href := HREF.search(page, at, stop)) is not None:
            at, value = href.end(), VALUE.match(page, href.end())
        if value is None:
            at = stop
        else:
            found.append(next(x for x in value.groups() if x is not None))
            at = value.end()
    return found


def derived(data: bytes) -> dict:
    """Both derivatives of a response record and what links them to it."""
    source, block = parsed(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *http = head.decode("latin-1").split("\r\n")
    if "WARC-Record-ID" not in source:
        raise ValueError("a record without an id")
    found = re.search(r"charset=[\"']?([\w.-]+)", " ".join(http), re.I)
    charset = found[1] if found else "utf-8"
    body = content(Headers(http), payload)
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    origin, uri = source["WARC-Record-ID"], source.get("WARC-Target-URI", "")
    digest = source.get("WARC-Payload-Digest") or sha1(payload)
    title, text = page_title(page), plain_text(page)
    links = [html.unescape(x) for x in page_links(page)]
    clean = lambda s: BLANK.sub(" ", s.replace("\n", " ")).strip()
    fields = [("http-status", status), *(("http-header", h) for h in http if h), ("charset", charset), ("payload-digest", digest)]
    fields += [("title", clean(html.unescape("".join((TAG.sub("", tagged(title)[0]), tagged(title)[1])))))] if title is not None else []
    fields += [("outlink", clean(x)) for x in links]
    carried = {k: source[k] for k in CARRIED if k in source}
    meta_id, text_id = record_id("metadata", origin), record_id("conversion", origin)
    meta_block, text_block = "".join(f"{k}: {v}\r\n" for k, v in fields).encode(), text.encode()
    meta = {"WARC-Type": "metadata", "WARC-Record-ID": meta_id, **carried, "WARC-Refers-To": origin, "Content-Type": "application/warc-fields"}
    conversion = {
        "WARC-Type": "conversion", "WARC-Record-ID": text_id, **carried, "WARC-Refers-To": origin,
        "WARC-Source-Payload-Digest": digest, "Content-Type": "text/plain; charset=utf-8", "WARC-Payload-Digest": sha1(text_block),
    }
    return {
        "response_id": origin, "target_uri": uri, "source_digest": digest, "metadata_id": meta_id, "conversion_id": text_id,
        "n_links": len(links), "metadata": record(meta, meta_block), "conversion": record(conversion, text_block),
    }


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, warc``: a response record of each stored page. Null urls and pages count as empty."""

    def make(batches):
        for batch in batches:
            urls, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys = batch.column(0).to_pylist()
            made = [response(u or "", t or "", str(k)) for u, t, k in zip(urls, texts, keys)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "warc": pa.array(made, pa.binary())})

    return pages.select(F.col(key).cast("long").alias("page_id"), url, page).mapInArrow(make, "page_id long, warc binary")


DERIVED = (
    "page_id long, response_id string, target_uri string, source_digest string, metadata_id string, "
    "conversion_id string, n_links long, metadata binary, conversion binary, error string"
)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of rows ``page_id, warc`` that hold one response record each.

    Both refer to the response, carry its target, date and payload digest, and have ids and digests of
    their own. Empty pages give an empty text; repeated rows give equal records; an empty table gives no
    rows; other columns are not read. Bytes that are no WARC record, or whose packed body is too large, give a row with
    ``error`` and nothing else; a null record is skipped. A page that leaves a script or a comment open shows nothing from there on.
    """

    def attempt(data: bytes) -> dict:
        try:
            return derived(data)
        except ValueError as ex:
            return {"error": str(ex)}

    def make(batches):
        for batch in batches:
            rows = [{"page_id": k} | attempt(w) for k, w in zip(batch.column("page_id").to_pylist(), batch.column("warc").to_pylist())]
            kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.binary(), pa.string()]
            names = [c.split()[0] for c in DERIVED.split(", ")]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds))))

    return records.where(F.col("warc").isNotNull()).select("page_id", "warc").mapInArrow(make, DERIVED)


def warc_digest(pages: DataFrame) -> DataFrame:
    """What the written derivatives say when they are read again."""

    def read(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                (meta, _), (conversion, text) = parsed(row["metadata"]), parsed(row["conversion"])
                rows.append(
                    {
                        "page_id": row["page_id"], "response_id": row["response_id"], "metadata_id": meta["WARC-Record-ID"],
                        "conversion_id": conversion["WARC-Record-ID"], "target_uri": conversion["WARC-Target-URI"],
                        "linked": meta["WARC-Refers-To"] == conversion["WARC-Refers-To"] == row["response_id"],
                        "source_digest": conversion["WARC-Source-Payload-Digest"], "n_links": row["n_links"],
                        "text_digest": conversion["WARC-Block-Digest"], "intact": sha1(text) == conversion["WARC-Block-Digest"],
                        "text_chars": len(text.decode()),
                    }
                )
            text, flag, long = pa.string(), pa.bool_(), pa.int64()
            kinds = [long, text, text, text, text, flag, text, long, text, flag, long]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip([c.split()[0] for c in DIGEST.split(", ")], kinds))))

    return derivatives(responses(pages)).where("error is null").drop("error").mapInArrow(read, DIGEST)


DIGEST = (
    "page_id long, response_id string, metadata_id string, conversion_id string, target_uri string, linked boolean, "
    "source_digest string, n_links long, text_digest string, intact boolean, text_chars long"
)
