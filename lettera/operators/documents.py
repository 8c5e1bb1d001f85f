"""From bytes to documents: each resource is sniffed, parsed and analysed; METS issues meet the ALTO pages that they name.

A resource is a row (url, body, content_type). One resource is a unit of work, and an issue
with its pages: neither is split, both are small.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from math import fsum
from urllib.parse import unquote, urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lettera.functions import text as T
from lettera.functions.batches import in_small_batches
from lettera.sources import parsers as P
from lettera.sources.tables import in_columns as to_batch
from lettera.sources.tables import with_format

from .store import DOCUMENT

COLUMNS = [f.strip().split()[0] for f in DOCUMENT.split(", ")]
#: Columns that need a text's analysis, whatever its source says.
ANALYSED = frozenset({"text_modern", "orthography", "old_score", "metadata"})
PAGES = {"alto": P.parse_alto, "page": P.parse_page_xml, "hocr": P.parse_hocr}
#: Divs of these types hold an issue, not an article.
WHOLE = ("newspaper", "issue", "volume")


@dataclass(frozen=True)
class Site:
    """Patterns, of one group each, that find ids in a URL, and the address of a viewer with {base}, {issue}, {article} and {n}."""

    base: str = ""
    issue: tuple[str, ...] = ()
    article: tuple[str, ...] = ()
    page: tuple[str, ...] = ()
    viewer: str = ""

    def ids(self, url: str) -> dict[str, str]:
        plain = unquote(url)
        first = lambda patterns: next((m[1] for p in patterns if (m := re.search(p, plain))), "")
        return {"issue_id": first(self.issue).strip("/"), "article_id": first(self.article), "page": first(self.page)}


def guess_date(*texts: str) -> str:
    """The first full date in any of the texts, unchecked; else the first year; else nothing."""
    full, year = r"(1[5-9]\d{2}|20\d{2})[-./](\d{1,2})[-./](\d{1,2})", r"\b(?:1[5-9]\d{2}|20[0-2]\d)\b"
    if m := next((m for t in texts if (m := re.search(full, t or ""))), None):
        return f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}"
    return next((m[0] for t in texts if (m := re.search(year, t or ""))), "")


def urls_in_json(payload: str, base: str) -> list[str]:
    """Addresses anywhere in the text, and paths under url, href, link or id, sorted."""
    paths = re.findall(r'"(?:url|href|link|id)"\s*:\s*"(/[^"]{2,200})"', payload)
    return sorted({*re.findall(r"https?://[^\s\"'<>\\]+", payload), *(urljoin(base, p) for p in paths)})


def build(url: str, kind: str, source: str, text: str, site: Site, issue: str = "", article: str = "", page: int | None = None, title: str = "", publication: str = "", date: str = "", language: str = "", confidence: float | None = None, metadata: dict | None = None, columns: frozenset[str] | None = None) -> dict:
    """A document. What its text says of language and date counts where the source says nothing.

    Where only some columns are asked for, what these need of the text's analysis is made; the other columns of the analysis are null.
    """
    if columns is None or ANALYSED & columns or ("date" in columns and not date) or ("language" in columns and not language):
        found = T.analyze_article(text)
        more = {"valoda": found["language"], "valodas_ticamība": found["language_confidence"]} | ({"vietvārdi": found["places"]} if found["places"] else {})
        said = json.dumps((metadata or {}) | more, ensure_ascii=False)
    else:
        found, said = dict.fromkeys(("text_modern", "orthography", "old_score", "language", "date")) | {"text_raw": T.clean_ocr(text) if "text_raw" in columns else None}, None
    return {
        "id": hashlib.sha1("|".join(p for p in (url, issue, article, str(page or ""), title[:60]) if p).encode()).hexdigest()[:20], "kind": kind, "url": url,
        "viewer_url": site.viewer.format(base=site.base.rstrip("/"), issue=issue, article=article, n=page or 1) if site.viewer and issue else "",
        "issue_id": issue, "article_id": article, "page_number": page, "publication": publication, "title": title.strip(), "date": date or found["date"], "language": language or found["language"],
        "text_raw": found["text_raw"], "text_modern": found["text_modern"], "orthography": found["orthography"], "old_score": found["old_score"], "ocr_confidence": confidence, "source_type": source,
        "metadata": said, "fetched_at": None,
    }


def in_columns(page: dict) -> list[dict]:
    """Blocks of a page by column, then downwards. The width tells how many columns of median width there are, 1 to 12."""
    blocks = page["blocks"]
    width = page["width"] or max((b["hpos"] + b["width"] for b in blocks), default=0) or 1
    sizes = sorted(b["width"] for b in blocks if b["width"] > 0)
    columns = min(12, max(1, round(width / sizes[len(sizes) // 2]))) if sizes else 1
    return sorted(blocks, key=lambda b: (b["hpos"] // (width / columns), b["vpos"], b["hpos"]))


def between(blocks: list[dict], begin: str, end: str) -> list[dict]:
    """Blocks from begin to end, either way round; no begin: all, an unknown one: none; an unknown end: the first alone."""
    if not begin:
        return blocks
    at = {b["id"]: i for i, b in reversed(list(enumerate(blocks)))}
    if begin not in at:
        return []
    low, high = sorted((at[begin], at.get(end, at[begin])))
    return blocks[low : high + 1]


def alto_files(mets: dict) -> list[dict]:
    """Files for use as ALTO; without any, XML files with alto in their name."""
    named = [f for f in mets["files"] if f["use"].upper() == "ALTO"]
    return named or [f for f in mets["files"] if f["href"].lower().endswith(".xml") and "alto" in f["href"].lower()]


def page_order(mets: dict) -> dict[str, int]:
    """Number of the page of each file, by the order of its div in the physical map, else by the div's place there."""
    divs = [d for d in mets["divs"] if d["map"] == "PHYSICAL"]
    pages = {d["preorder"]: P.number(d["ord"]) or i for i, d in enumerate(divs, 1) if d["type"].lower() in ("page", "physical_page", "")}
    out: dict[str, int] = {}
    for a in mets["areas"]:
        if a["div"] in pages:
            out.setdefault(a["file_id"], pages[a["div"]])
    return out


def assemble_issue(mets: dict, pages: dict[str, dict], types: tuple[str, ...] = ()) -> list[dict]:
    """Articles of the logical divs, of the types asked for, or of all but whole issues; where there are none, each page is one."""
    order, out = page_order(mets), []
    areas: dict[int, list[dict]] = {}
    for a in mets["areas"]:
        areas.setdefault(a["div"], []).append(a)
    for d in mets["divs"]:
        kind = d["type"].lower()
        if d["map"] != "LOGICAL" or (kind not in map(str.lower, types) if types else kind in WHOLE):
            continue
        blocks, numbers = [], set()
        for a in areas.get(d["preorder"], ()):
            if page := pages.get(a["file_id"]):
                blocks += [b for b in between(page["blocks"], a["begin"], a["end"]) if b["text"].strip()]
                numbers |= {page["number"] or order.get(a["file_id"], 0)} - {0}
        if blocks:
            known = [b["confidence"] for b in blocks if b["confidence"] is not None]
            out.append({"id": d["div_id"] or f"div{len(out) + 1}", "title": d["label"].strip(), "type": d["type"] or "ARTICLE", "text": "\n\n".join(b["text"] for b in blocks), "pages": sorted(numbers), "blocks": len(blocks), "confidence": fsum(known) / len(known) if known else None})
    if out:
        return out
    texts = {f: "\n\n".join(b["text"] for b in in_columns(p) if b["text"].strip()) for f, p in pages.items()}
    return [{"id": f, "title": "", "type": "PAGE", "text": t, "pages": [pages[f]["number"] or order.get(f, 0)], "blocks": len(pages[f]["blocks"]), "confidence": pages[f]["confidence"]} for f, t in texts.items() if t]


def from_response(url: str, body: bytes, content_type: str = "", site: Site = Site(), linked: dict[str, bytes] | None = None, columns: frozenset[str] | None = None) -> tuple[list[dict], list[str]]:
    """The documents of a resource, and the addresses it names. linked: bodies of a METS issue's ALTO files by file id. columns: those of the documents that are asked for, as build takes them; then an issue's addresses are left out."""
    kind, ids = P.sniff(body, content_type), site.ids(url)
    issue, no = ids["issue_id"], int(ids["page"]) if ids["page"].isdigit() else None
    if kind in PAGES:
        page = PAGES[kind](body, strings=False)
        text = "\n\n".join(b["text"] for b in in_columns(page) if b["text"].strip())
        meta = {"alto_page_id": page["id"], "blocks": len(page["blocks"])}
        return [build(url, "page", kind, text, site, issue, page=page["number"] or no, language=page["language"], confidence=page["confidence"], metadata=meta, columns=columns)] if text.strip() else [], []
    if kind == "mets":
        mets = P.parse_mets(body)
        return from_mets(url, mets, site, issue, linked or {}, columns), [urljoin(url, f["href"]) for f in alto_files(mets)] if columns is None else []
    if kind == "tei":
        tei = P.parse_tei(body)
        date, meta = guess_date(tei["date"], url), {"title": tei["title"], "date": tei["date"]}
        return [build(url, "article", "tei", a["text"], site, issue, a["id"], title=a["title"], date=date, publication=tei["title"], metadata=meta, columns=columns) for a in tei["articles"]], []
    if kind in ("html", "xml"):
        page = P.parse_html(P.decode(body), url)
        said = lambda *names: next((page["meta"][n] for n in names if page["meta"].get(n)), "")
        title = said("citation_title", "og:title")
        if len(page["main_text"]) < 200 and not title:
            return [], page["links"]
        date = guess_date(said("citation_date", "citation_publication_date", "dc.date"), page["title"], url)
        made = build(url, "web", "html", page["main_text"], site, issue, ids["article_id"], no, title or said("dc.title") or page["title"], said("citation_journal_title", "og:site_name"), date, page["lang"], metadata={"meta": page["meta"], "json_ld": page["json_ld"][:3]}, columns=columns)
        return [made], page["links"]
    if kind == "text":
        text = P.decode(body)
        return [build(url, "page", "text", text, site, issue, page=no, columns=columns)] if text.strip() else [], []
    return [], urls_in_json(P.decode(body), url) if kind == "json" else []


def from_mets(url: str, mets: dict, site: Site, issue: str, linked: dict[str, bytes], columns: frozenset[str] | None = None) -> list[dict]:
    meta, pages = mets["metadata"], {}
    for f in alto_files(mets):
        if f["file_id"] in linked:
            try:
                pages[f["file_id"]] = P.parse_alto(linked[f["file_id"]], strings=False)
            except (ValueError, SyntaxError):
                continue  # a broken page leaves the others
    issue, date = issue or meta.get("identifier", ""), guess_date(meta.get("date", ""), url)
    publication, rest = meta.get("publication") or meta.get("title", ""), {k: v for k, v in meta.items() if k != "title"}
    out = [
        build(url, "page" if a["type"].upper() == "PAGE" else "article", "mets+alto", a["text"], site, issue, a["id"], (a["pages"] or [None])[0], a["title"], publication, date, meta.get("language", ""), a["confidence"], {"mets_type": a["type"], "pages": a["pages"], "blocks": a["blocks"]} | rest, columns)
        for a in assemble_issue(mets, pages)
    ]
    if not out and not pages:  # the issue is known, though nothing of it can be read
        out = [build(url, "issue", "mets", "", site, issue, title=meta.get("title", ""), publication=publication, date=date, metadata=meta, columns=columns)]
    return out


#: Documents that a batch has.
ROWS = 500


def read(url: str, body: bytes | None, kind: str | None, site: Site, columns: frozenset[str] = frozenset(COLUMNS)) -> list[dict]:
    """The documents of a resource; of one that cannot be parsed, none."""
    try:
        return from_response(url, body or b"", kind or "", site, columns=columns)[0]
    except (ValueError, SyntaxError):
        return []


def in_batches(rows: DataFrame, read_row, columns: Sequence[str]) -> DataFrame:
    """Some columns of DOCUMENT, of the documents that read_row gives for each row's values and the set of these columns, some hundreds at a time."""
    schema = ", ".join(f for f in DOCUMENT.split(", ") if f.split()[0] in columns)
    fields, asked = to_arrow_schema(_parse_datatype_string(schema)), frozenset(columns)

    def run(batches):
        for b in batches:
            found: list[tuple] = []
            for row in zip(*b.columns):
                found += [tuple(map(d.__getitem__, fields.names)) for d in read_row(*(v.as_py() for v in row), asked)]
                if len(found) >= ROWS:
                    yield to_batch(found, fields)
                    found = []
            yield to_batch(found, fields)

    in_small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def made(resources: DataFrame, site: Site) -> DataFrame:
    """Documents (DOCUMENT) of resources (url, body, content_type)."""
    return in_batches(resources.select("url", "body", "content_type"), lambda url, body, kind, asked: read(url, body, kind, site, asked), COLUMNS)


def issue_documents(resources: DataFrame, site: Site = Site(), columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Documents of the METS issues among the resources, with the ALTO pages that they name. Columns that are not asked for are not made.

    An issue is parsed once: a row for each file it names, of which the first has the issue itself as JSON, meets the file's
    resource by its address, and the rows of an issue come together again.
    """
    issues = with_format(resources.where("url is not null")).where("format = 'mets'").select("url", "body", "content_type")
    schema = "url string, own binary, mets string, file_id string, href string"
    fields = to_arrow_schema(_parse_datatype_string(schema))

    def named(batches):
        for b in batches:
            rows = []
            for url, body, kind in zip(b["url"].to_pylist(), b["body"].to_pylist(), b["content_type"].to_pylist()):
                try:
                    mets = P.parse_mets(body or b"")
                    files = [(f["file_id"], urljoin(url, f["href"])) for f in alto_files(mets)]
                except (ValueError, SyntaxError):
                    continue
                own = hashlib.sha1((body or b"") + (kind or "").encode()).digest()  # issues of one address stay apart
                rows += [(url, own, None if k else json.dumps(mets), f, h) for k, (f, h) in enumerate(files or [(None, None)])]
            yield to_batch(rows, fields)

    def read_issue(url, mets, linked, asked):
        try:
            return from_mets(url, json.loads(mets), site, site.ids(url)["issue_id"], {p["file_id"]: p["page"] for p in linked or ()}, asked)
        except (ValueError, SyntaxError):
            return []

    in_small_batches(resources.sparkSession)
    # issues are few bytes but much to parse, and lie in the partitions where they were found: they are dealt to all cores
    files = issues.repartition(4 * issues.sparkSession.sparkContext.defaultParallelism, "url").mapInArrow(named, schema)
    bodies = resources.where("url is not null").select(F.col("url").alias("at"), F.coalesce("body", F.lit(b"")).alias("page"))
    met = files.join(bodies, F.col("href") == F.col("at"), "left")
    page = F.when(F.col("page").isNotNull(), F.struct("file_id", "page"))
    whole = met.groupBy("url", "own").agg(F.max("mets").alias("mets"), F.collect_list(page).alias("linked"))
    return in_batches(whole.select("url", "mets", "linked"), read_issue, columns)


def documents(resources: DataFrame, site: Site = Site()) -> DataFrame:
    """Documents (DOCUMENT) of resources (url, body, content_type). An ALTO page that an issue names is read with the issue, and as a page too.

    A resource that cannot be parsed gives none, nor does one with a null url; a null body is empty. An issue's address must be its own.
    """
    single = with_format(resources.where("url is not null")).where("format <> 'mets'").select("url", "body", "content_type")
    return made(single, site).unionByName(issue_documents(resources, site))
