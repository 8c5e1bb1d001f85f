"""Parsers of OCR and structural formats: bytes in, plain dictionaries out; namespaces are ignored."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from functools import lru_cache
from html.parser import HTMLParser
from math import fsum
from urllib.parse import urldefrag, urljoin

CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
CONTROL_BYTES = bytes(i for i in range(32) if CONTROL.match(chr(i)))
DECLARATION = re.compile(r"^\s*<\?xml[^>]*\?>")


def decode(data: bytes, charset: str = "") -> str:
    """By the given charset, by that of an XML declaration, else the first of UTF-8, cp1257, ISO 8859-13 and Latin-1 that fits."""
    declared = re.search(rb"encoding=[\"']([\w.-]+)", data[:200])
    for name in (charset, declared[1].decode() if declared else "", "utf-8", "cp1257", "iso-8859-13"):
        try:
            return data.decode(name) if name else data.decode("utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


def markup(data: bytes | str) -> str:
    """XML as the parser takes it: without its declaration, and without control characters."""
    text = (decode(data) if isinstance(data, bytes) else data).lstrip("﻿")
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw.translate(None, CONTROL_BYTES)) < len(raw):
        text = CONTROL.sub(" ", text)
    return DECLARATION.sub("", text)


def xml(data: bytes | str) -> ET.Element:
    return ET.fromstring(markup(data))


class Names(dict):
    """Local names by tag; those met are kept, up to a bound."""

    def __missing__(self, tag) -> str:
        if len(self) > 10_000:
            self.clear()
        self[tag] = found = tag.rpartition("}")[2] if isinstance(tag, str) else ""
        return found


LOCAL = Names()
#: What stands in the place of an attribute's local name after a prefix.
PREFIXED = re.compile(r":([^\s:=\"'<>]+)\s*=")


def name(e: ET.Element) -> str:
    return LOCAL[e.tag]


def attr(e: ET.Element, key: str, default: str = "") -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == key), default)


def reader(text: str):
    """attr for the elements of a document: by look-up, where no attribute of it has a prefix but those that declare one."""
    prefixed = set(PREFIXED.findall(text))
    if not prefixed and "<!ATTLIST" not in text:
        return ET.Element.get
    if "<!ATTLIST" in text:
        return attr
    return lambda e, key, default="": attr(e, key, default) if key in prefixed else e.get(key, default)


def mean(values: list[float]) -> float | None:
    return fsum(values) / len(values) if values else None


def number(text: str | None, default=0) -> int:
    try:
        return int(float(text))
    except (TypeError, ValueError):
        return default


def real(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


# Formats by what stands in the first bytes of markup, in order of trial, and how many bytes are looked at.
FORMATS = [
    ("alto", ["<alto"], 2048), ("page", ["<pcgts", "pagecontent"], 2048), ("mets", ["<mets", "mets/"], 2048), ("tei", ["<tei"], 2048), ("sitemap", ["urlset", "sitemapindex"], 2048),
    ("oai", ["oai-pmh"], 2048), ("hocr", ["ocr_page", "ocr_line"], 4096), ("html", ["<html", "<!doctype html"], 2048),
]


def sniff(data: bytes, content_type: str = "") -> str:
    """The format, by the first bytes and the content type. Without a content type all that is no markup or JSON is text."""
    kind, start = content_type.lower(), data[:2048].lstrip()[:1]
    if start == b"<":
        head = data[:4096].lower().decode("latin-1")
        return next((f for f, marks, n in FORMATS if any(m in head[:n] for m in marks)), "html" if kind.startswith("text/html") else "xml")
    if start in (b"{", b"["):
        return "json"
    return "html" if kind.startswith("text/html") else "text" if kind.startswith("text/") or not kind else "binary"


def line_of(strings: list[dict]) -> dict:
    return {"text": " ".join(s["content"] for s in strings if s["content"]), "confidence": mean([s["confidence"] for s in strings if s["confidence"] is not None]), "strings": strings}


def bare_line(contents: list[str], confidences: list[float | None]) -> dict:
    """A line as line_of gives, without its strings."""
    return {"text": " ".join(filter(None, contents)), "confidence": mean([c for c in confidences if c is not None]), "strings": []}


def block_of(id_: str, lines: list[dict], box: tuple[int, int, int, int], parent: str = "", kind: str = "") -> dict:
    """A block's confidence is the mean of its lines' means."""
    confidence = mean([x["confidence"] for x in lines if x["confidence"] is not None])
    return {"id": id_, "parent": parent, "type": kind, "hpos": box[0], "vpos": box[1], "width": box[2], "height": box[3], "text": "\n".join([x["text"] for x in lines]), "confidence": confidence, "lines": lines}


def page_of(id_: str, no: int, width: int, height: int, blocks: list[dict], language: str = "") -> dict:
    confidence = mean([b["confidence"] for b in blocks if b["confidence"] is not None])
    return {"id": id_, "number": no, "width": width, "height": height, "language": language, "blocks": blocks, "confidence": confidence}


def parse_alto(data: bytes, join_over_lines: bool = False, strings: bool = True) -> dict:
    """A page. A hyphenated word is whole in its first half; the second half is passed over if it is in the same line, or in the next too with join_over_lines.

    Without strings, lines have their texts and confidences alone; so for the other formats.
    """
    text, local = markup(data), LOCAL
    root, get = ET.fromstring(text), reader(text)
    page = language = None
    spoken = "Language" in text
    for e in root.iter():
        n = local[e.tag]
        if n == "Page" and page is None:
            page = e
            if not spoken:
                break
        elif n == "Language" and language is None and e.text:
            language = e.text.strip()
    page = root if page is None else page
    blocks: list[dict] = []
    half = False
    box = lambda e: (number(get(e, "HPOS", "")), number(get(e, "VPOS", "")), number(get(e, "WIDTH", "")), number(get(e, "HEIGHT", "")))

    def line(e):
        nonlocal half
        half = half and join_over_lines
        found, contents, confidences = [], [], []
        for s in e:
            if local[s.tag] != "String":
                continue
            content, part = get(s, "CONTENT", ""), get(s, "SUBS_TYPE", "")
            if part:
                part = part.lower()
                if part == "hyppart2" and half:
                    half = False
                    continue
                if part == "hyppart1":
                    content, half = get(s, "SUBS_CONTENT", content), True
            if content:
                confidence = real(get(s, "WC", "") or None)
                if strings:
                    h, v, w, t = box(s)
                    found.append({"content": content, "hpos": h, "vpos": v, "width": w, "height": t, "confidence": confidence, "style": get(s, "STYLEREFS", "")})
                contents.append(content)
                confidences.append(confidence)
        return line_of(found) if strings else bare_line(contents, confidences)

    def walk(e, parent):
        n = local[e.tag]
        if n == "TextBlock":
            lines = [x for x in [line(n) for n in e.iter() if local[n.tag] == "TextLine"] if x["text"]]
            if lines:
                blocks.append(block_of(get(e, "ID", ""), lines, box(e), parent, get(e, "TYPE", "") or get(e, "STYLEREFS", "")))
            return
        for c in e:
            walk(c, parent or (get(c, "ID", "") if local[c.tag] == "ComposedBlock" else ""))

    walk(page, "")
    return page_of(get(page, "ID", ""), number(get(page, "PHYSICAL_IMG_NR", "")), number(get(page, "WIDTH", "")), number(get(page, "HEIGHT", "")), blocks, language or "")


def points_box(points: str) -> tuple[int, int, int, int]:
    xy = [(number(a), number(b)) for a, b in re.findall(r"(-?[\d.]+),(-?[\d.]+)", points)]
    if not xy:
        return 0, 0, 0, 0
    xs, ys = zip(*xy)
    return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)


def parse_page_xml(data: bytes, strings: bool = True) -> dict:
    source, local = markup(data), LOCAL
    root, get = ET.fromstring(source), reader(source)
    page, regions = None, []
    for e in root.iter():
        n = local[e.tag]
        if n == "Page" and page is None:
            page = e
        elif n == "TextRegion":
            regions.append(e)
    page = root if page is None else page

    def coords(e):
        for c in e:
            if local[c.tag] == "Coords":
                return points_box(get(c, "points", ""))
        return points_box("")

    def own_text(e):
        for c in e:
            if local[c.tag] == "TextEquiv":
                return next((u.text or "" for u in c if local[u.tag] in ("Unicode", "PlainText")), ""), real(get(c, "conf", "") or None)
        return "", None

    def line(e):
        text, conf = own_text(e)
        contents = text.split()
        if not strings:
            return bare_line(contents, [conf] * len(contents))
        h, v, w, t = coords(e)
        return line_of([{"content": x, "hpos": h, "vpos": v, "width": w, "height": t, "confidence": conf, "style": ""} for x in contents])

    blocks = []
    for r in regions:
        lines = [x for x in [line(e) for e in r if local[e.tag] == "TextLine"] if x["text"]]
        if not lines and own_text(r)[0].strip():
            lines = [line(r)]
        if lines:
            blocks.append(block_of(get(r, "id", ""), lines, coords(r), "", get(r, "type", "")))
    if not blocks and (lines := [x for x in [line(e) for e in root.iter() if local[e.tag] == "TextLine"] if x["text"]]):
        blocks.append(block_of("r1", lines, (0, 0, 0, 0)))
    no = re.search(r"\d+", get(page, "imageFilename", ""))
    return page_of(get(page, "id", ""), number(no[0]) if no else 0, number(get(page, "imageWidth", "")), number(get(page, "imageHeight", "")), blocks)


BBOX, WCONF, HOCR_LINE = re.compile(r"bbox (\d+) (\d+) (\d+) (\d+)"), re.compile(r"x_wconf (\d+)"), re.compile(r"class=[\"']ocr_line[\"']")
LINES = frozenset({"ocr_line", "ocrx_line", "ocr_header", "ocr_caption"})


@lru_cache(1000)
def hocr_kinds(classes: str) -> tuple[bool, bool, bool]:
    """Whether a class attribute is that of a page, a line, a word."""
    kinds = classes.split()
    return "ocr_page" in kinds, not LINES.isdisjoint(kinds), "ocrx_word" in kinds


def parse_hocr(data: bytes, strings: bool = True) -> dict:
    """Each line is a block of its own unless data-block names one. Markup that is no XML is read by pattern, without confidences."""
    text = decode(data)
    place = lambda title: tuple(map(int, m.groups())) if (m := BBOX.search(title)) else (0, 0, 0, 0)
    sized = lambda b: (b[0], b[1], b[2] - b[0], b[3] - b[1])
    whole = lambda e: ("".join(e.itertext()) if len(e) else e.text or "").strip()
    blocks: dict[str, list[dict]] = {}
    boxes: dict[str, tuple] = {}
    size, no = (0, 0, 0, 0), 0

    def word(w, get):
        title = get(w, "title", "")
        confidence = int(c[1]) / 100 if (c := WCONF.search(title)) else None
        return {"content": whole(w), **(dict(zip(("hpos", "vpos", "width", "height"), sized(place(title)))) if strings else {}), "confidence": confidence, "style": ""}

    try:
        source = markup(re.sub(r"<!DOCTYPE[^>]*>|&(?!amp;|lt;|gt;|quot;|apos;|#)\w+;", " ", text))
        root, get = ET.fromstring(source), reader(source)
        for e in root.iter():
            is_page, is_line, _ = hocr_kinds(get(e, "class", ""))
            if is_page:
                size, no = place(get(e, "title", "")), number((re.search(r"ppageno (\d+)", get(e, "title", "")) or [0, 0])[1])
            if is_line:
                words = [word(w, get) for w in e.iter() if hocr_kinds(get(w, "class", ""))[2]]
                words = words or [{"content": whole(e), "hpos": 0, "vpos": 0, "width": 0, "height": 0, "confidence": None, "style": ""}]
                x = line_of(words) if strings else bare_line([w["content"] for w in words], [w["confidence"] for w in words])
                if x["text"]:
                    key = get(e, "data-block", "") or get(e, "id", "") or f"line{len(blocks) + 1}"
                    blocks.setdefault(key, []).append(x)
                    if key not in boxes:
                        boxes[key] = sized(place(get(e, "title", "")))
    except ET.ParseError:
        starts = [m.start() for m in HOCR_LINE.finditer(text)]
        for k, (at, end) in enumerate(zip(starts, [*starts[1:], len(text)]), 1):
            found = re.findall(r"class=[\"']ocrx_word[\"'][^>]*>([^<]+)", text[at:end])
            if found:
                blocks[f"line{k}"] = [line_of([{"content": w.strip(), "hpos": 0, "vpos": 0, "width": 0, "height": 0, "confidence": None, "style": ""} for w in found])]
                boxes[f"line{k}"] = (0, 0, 0, 0)
    return page_of("", no, size[2], size[3], [block_of(k, v, boxes[k]) for k, v in blocks.items()])


# Metadata fields and the elements that hold them, in order of trial.
MODS = {"title": ["title"], "publication": ["relatedItem", "title"], "date": ["dateIssued", "date"], "language": ["languageTerm", "language"], "publisher": ["publisher"], "identifier": ["identifier", "recordIdentifier"], "place": ["placeTerm"]}


TAGS = frozenset(t for tags in MODS.values() for t in tags)


def parse_mets(data: bytes) -> dict:
    """files, divs (flattened in preorder, with the map they are in and their parent) and areas, and metadata. In one pass over the elements."""
    text, local = markup(data), LOCAL
    root, get = ET.fromstring(text), reader(text)
    files, divs, areas, said, groups, maps = [], [], [], {}, [], []
    for e in root.iter():
        n = local[e.tag]
        if n in TAGS:
            if n not in said and (value := (e.text or "").strip()):
                said[n] = value
        elif n == "fileGrp":
            groups.append(e)
        elif n == "structMap":
            maps.append(e)
    meta = {field: value for field, tags in MODS.items() if (value := next((said[t] for t in tags if t in said), ""))}
    for group in groups:
        use = get(group, "USE", "")
        for f in group:
            if local[f.tag] == "file":
                href = next((get(x, "href", "") for x in f if local[x.tag] == "FLocat"), "")
                files.append({"file_id": get(f, "ID", ""), "href": href, "use": get(f, "USE", "") or use, "mimetype": get(f, "MIMETYPE", "")})

    def walk(e, kind, parent):
        index, pos = len(divs), 0
        divs.append({"map": kind, "preorder": index, "parent": parent, "div_id": get(e, "ID", ""), "type": get(e, "TYPE", ""), "label": get(e, "LABEL", ""), "ord": get(e, "ORDER", ""), "dmdid": get(e, "DMDID", "")})
        for p in e:
            if local[p.tag] == "fptr":
                if own := get(p, "FILEID", ""):
                    areas.append({"div": index, "pos": pos, "file_id": own, "begin": "", "end": "", "betype": ""})
                    pos += 1
                for a in p.iter():
                    if local[a.tag] == "area":
                        areas.append({"div": index, "pos": pos, "file_id": get(a, "FILEID", ""), "begin": get(a, "BEGIN", ""), "end": get(a, "END", ""), "betype": get(a, "BETYPE", "")})
                        pos += 1
        for c in e:
            if local[c.tag] == "div":
                walk(c, kind, index)

    seen: set[str] = set()
    for m in maps:
        kind = get(m, "TYPE", "").upper() or "LOGICAL"
        if get(m, "TYPE", "") or "LOGICAL" not in seen:
            seen.add(kind)
            for d in m:
                if local[d.tag] == "div":
                    walk(d, kind, None)
    return {"files": files, "divs": divs, "areas": areas, "metadata": meta}


TEI_TEXTS = frozenset({"p", "l", "lg", "ab", "item"})


def parse_tei(data: bytes) -> dict:
    """Articles are the divs without divs; without any, the body is one named tei1."""
    text, local = markup(data), LOCAL
    root, get = ET.fromstring(text), reader(text)
    squeeze = lambda e: " ".join(("".join(e.itertext()) if len(e) else e.text or "").split())
    articles, body, said = [], None, {"title": "", "date": ""}
    for d in root.iter():
        n = local[d.tag]
        if n == "div":
            head, parts = None, []
            for e in d.iter():
                k = local[e.tag]
                if k == "div" and e is not d:
                    break
                if k == "head" and head is None:
                    head = squeeze(e)
                elif k in TEI_TEXTS and (t := squeeze(e)):
                    parts.append(t)
            else:
                if head or parts:
                    articles.append({"id": get(d, "id", ""), "type": get(d, "type", ""), "title": head or "", "text": "\n\n".join(parts)})
        elif n == "body":
            body = d if body is None else body
        elif n in said and not said[n]:
            said[n] = squeeze(d)
    if not articles and body is not None:
        articles.append({"id": "tei1", "type": "", "title": "", "text": squeeze(body)})
    return {"title": said["title"], "date": said["date"], "articles": articles}


def sitemap_urls(data: bytes) -> tuple[list[str], list[str]]:
    """Page URLs, and URLs of further sitemaps."""
    root = xml(data)
    found = [(name(p), (c.text or "").strip()) for p in root.iter() for c in p if name(c) == "loc"]
    return [u for k, u in found if k == "url" and u], [u for k, u in found if k == "sitemap" and u]


def oai_headers(data: bytes) -> tuple[list[dict], str]:
    """Identifiers with datestamp and sets, and the token that resumes the list."""
    root = xml(data)
    text = lambda e, tag: next(((c.text or "").strip() for c in e if name(c) == tag), "")
    rows = [{"identifier": text(h, "identifier"), "datestamp": text(h, "datestamp"), "sets": [(c.text or "").strip() for c in h if name(c) == "setSpec"]} for h in root.iter() if name(h) == "header"]
    return rows, next(((e.text or "").strip() for e in root.iter() if name(e) == "resumptionToken"), "")


def rdf_aggregates(data: bytes, site: str, only: str = "") -> list[str]:
    found = (attr(e, "resource") for e in xml(data).iter())
    return list(dict.fromkeys(u for x in found if x and (u := urljoin(site.rstrip("/") + "/", x)) and only in u))


class Page(HTMLParser):
    ASIDE = {"nav", "header", "footer", "aside", "form"}
    SILENT = {"script", "style", "noscript", "template"}

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.lang = base, "", ""
        self.meta, self.link_texts, self.json_ld, self.scripts = {}, {}, [], []
        self.open: list[str] = []
        self.text, self.main, self.anchor, self.script = [], [], None, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        if tag == "meta" and (k := a.get("name") or a.get("property") or a.get("http-equiv")):
            self.meta[k.lower()] = a.get("content", "")
        if tag == "link" and (rel := a.get("rel", "").lower()) in ("canonical", "alternate", "next", "prev"):
            self.meta[rel] = absolute(self.base, a.get("href", ""))
        if tag in ("a", "iframe", "frame", "embed") and (u := absolute(self.base, a.get("href") or a.get("src") or "")):
            self.link_texts.setdefault(u, "")
            self.anchor = u if tag == "a" else self.anchor
        if tag == "script":
            self.script = a.get("type", "")
            if u := absolute(self.base, a.get("src", "")):
                self.scripts.append(u)
        if tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol"):
            self.put("\n")
        if tag in self.ASIDE | self.SILENT | {"title"}:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        if tag == "a":
            self.anchor = None
        if tag == "script":
            self.script = None
        if tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"):
            self.put("\n")

    def put(self, data):
        if not self.SILENT & set(self.open):
            self.text.append(data)
            if not self.ASIDE & set(self.open):
                self.main.append(data)

    def handle_data(self, data):
        if "title" in self.open:
            self.title += data
        elif self.script is not None:
            if "ld+json" in self.script:
                self.json_ld.append(data.strip())
        else:
            if self.anchor:
                self.link_texts[self.anchor] = tidy(f"{self.link_texts[self.anchor]} {data}")[:300]
            self.put(data)


def tidy(text: str) -> str:
    text = re.sub(r"[ \t\r\f\v\xa0]+", " ", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def absolute(base: str, href: str) -> str:
    href = href.strip()
    return "" if not href or href.startswith("#") or re.match(r"(?i)(javascript|mailto|tel|data):", href) else urljoin(base, href)


def parse_html(markup: str, base: str = "") -> dict:
    p = Page(base)
    p.feed(markup or "")
    p.close()
    return {"title": tidy(p.title), "lang": p.lang, "meta": p.meta, "links": list(p.link_texts), "link_texts": p.link_texts, "text": tidy("".join(p.text)), "main_text": tidy("".join(p.main)), "json_ld": p.json_ld, "scripts": p.scripts}


# Keys that name a hit, and keys that describe one; of a hit's URL, title and snippet the first that says something counts.
NAMES, DESCRIBES = {"url", "href", "id", "identifier"}, {"title", "label", "name", "snippet", "text", "heading"}
HIT_KEYS = {"url": ("url", "href", "id"), "title": ("title", "label", "name"), "snippet": ("snippet", "text")}


def json_rows(value, depth: int = 0) -> list[dict]:
    """Objects with a key that names and one that describes, in any case of letters, at most six levels down; a parent before what it holds."""
    if depth > 6 or not isinstance(value, (list, dict)):
        return []
    keys = {k.lower() for k in value} if isinstance(value, dict) else set()
    own = [value] if keys & NAMES and keys & DESCRIBES else []
    return own + [h for x in (value.values() if isinstance(value, dict) else value) for h in json_rows(x, depth + 1)]


def json_hits(payload: str, base: str = "") -> list[dict]:
    """Hits of a search answer in JSON: url (joined to base), title, snippet of at most 400 characters, and the text in which ids are looked for. What is no JSON has none."""
    try:
        rows = json_rows(json.loads(payload))
    except ValueError:
        return []
    out = []
    for row in rows:
        hit = {name: next((str(row[k]) for k in keys if row.get(k)), "") for name, keys in HIT_KEYS.items()}
        hit["url"] = urljoin(base, hit["url"]) if hit["url"] else ""
        out.append(hit | {"snippet": hit["snippet"][:400], "ids_in": hit["url"] or json.dumps(row, ensure_ascii=False)})
    return out


def html_hits(markup: str, base: str = "") -> list[dict]:
    """Links of a search answer in HTML with their texts; those whose URL has no ids are for the caller to leave out."""
    page = parse_html(markup, base)
    return [{"url": u, "title": page["link_texts"].get(u, ""), "snippet": "", "ids_in": u} for u in page["links"]]


def otsu(histogram: list[int]) -> int:
    """The grey level that parts a histogram of 256 into the two classes of least variance."""
    total, whole = sum(histogram), sum(i * n for i, n in enumerate(histogram))
    best, level, weight, part = -1.0, 0, 0, 0
    for i, n in enumerate(histogram):
        weight, part = weight + n, part + i * n
        if 0 < weight < total:
            between = weight * (total - weight) * (part / weight - (whole - part) / (total - weight)) ** 2
            if between > best:
                best, level = between, i
    return level


def without_fragment(url: str) -> str:
    return urldefrag(url)[0]
