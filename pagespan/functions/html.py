"""HTML pages to metrics: a scanner of markup, and a fold over what it finds. One pass, no tree."""

from __future__ import annotations

import html as _entities
import re
from collections.abc import Iterator
from html.entities import html5
from typing import NamedTuple

from . import text as T
from . import urls as U


class Markup(NamedTuple):
    kind: str  # text, start, end
    name: str = ""
    attrs: dict[str, str] = {}
    closed: bool = False
    text: str = ""


class PageError(ValueError):
    """The page is beyond a limit."""


# Elements whose content is text up to their own end tag; the last two decode entities.
RAW = {"script", "style", "iframe", "noembed", "noframes", "xmp", "plaintext", "title", "textarea"}
DECODED = {"title", "textarea"}
# Start tags that leave the head open.
HEAD_TAGS = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}

_OPEN = re.compile(r"<(?:(?P<tag>/?[A-Za-z])|(?P<comment>!--)|(?P<other>[!?/]))")
_NAME = re.compile(r"[^\s/>\x00]+")
_ATTR = re.compile(r"""[\s/]*(?P<key>[^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"(?P<d>[^"]*)"|'(?P<s>[^']*)'|(?P<u>[^\s>]*)))?""")
_COMMENT_END = re.compile(r"--!?>|^-?>")
_CLOSED = re.compile(r"&(?:#[0-9]+|#[Xx][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def closed_references(s: str) -> str:
    """s with those character references decoded that end in a semicolon."""
    return _CLOSED.sub(lambda m: _entities.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], s)


def scan(doc: str, most: int | None = None, bare: bool = True) -> Iterator[Markup]:
    """Text, start and end tags in order. most: characters that one token may have, else PageError. bare: whether names
    such as &amp are references without a semicolon too, as HTML has it."""
    unescape = _entities.unescape if bare else closed_references
    doc = doc.replace("\r\n", "\n").replace("\r", "\n")
    at, n = 0, len(doc)

    def fits(size: int) -> None:
        if most is not None and size > most:
            raise PageError(f"HTML token exceeds configured limit of {most} bytes")

    while at < n:
        m = _OPEN.search(doc, at)
        if not m:
            fits(n - at)
            yield Markup("text", text=unescape(doc[at:]))
            return
        if m.start() > at:
            fits(m.start() - at)
            yield Markup("text", text=unescape(doc[at : m.start()]))
        at = m.start()
        if m["comment"]:
            e = _COMMENT_END.search(doc, at + 4)
            fits((e.end() if e else n) - at)
            at = e.end() if e else n
        elif m["other"]:
            e = doc.find(">", at)
            fits((e if e >= 0 else n) - at)
            at = e + 1 if e >= 0 else n
        else:
            end = m["tag"][0] == "/"
            name = _NAME.match(doc, at + 1 + end)
            i, attrs = name.end(), {}
            while True:
                j = re.compile(r"[\s/]*").match(doc, i).end()
                if j >= n or doc[j] == ">":
                    break
                a = _ATTR.match(doc, i)
                if not a:
                    j = n
                    break
                value = next((v for v in (a["d"], a["s"], a["u"]) if v is not None), "")
                attrs[a["key"].lower()] = unescape(value)
                i = a.end()
            fits(min(j + 1, n) - at)
            if j >= n:
                return  # the document ends within a tag
            closed = doc[j - 1] == "/"
            at = j + 1
            tag = name[0].lower()
            yield Markup("end", tag) if end else Markup("start", tag, attrs, closed)
            if not end and tag in RAW:
                e = None if tag == "plaintext" else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(doc, at)
                stop = e.start() if e else n
                if stop > at:
                    fits(stop - at)
                    raw = doc[at:stop]
                    yield Markup("text", text=unescape(raw) if tag in DECODED else raw)
                at = stop


class Directives:
    """Comma-separated directives, each once in its first spelling; those that forbid most come first."""

    RANK = {"noindex": 0, "none": 0, "nofollow": 1}

    def __init__(self) -> None:
        self.by_key: dict[str, str] = {}

    def add(self, raw: str) -> None:
        for d in map(T.trim, raw.split(",")):
            if d:
                self.by_key.setdefault(d.lower(), d)

    def __str__(self) -> str:
        rank = lambda d: self.RANK.get(T.trim(d.lower().rpartition(":")[2]), 2)
        return ", ".join(sorted(self.by_key.values(), key=rank))


def header_directives(values: list[str]) -> tuple[str, bool, int]:
    d = Directives()
    for v in values:
        d.add(v)
    return T.bounded(str(d), T.BOUNDS["robots"])


def content_type_is_html(raw: str | None) -> bool:
    """Whether a Content-Type header is well formed and names HTML."""
    kind, *params = (raw or "").split(";")
    if T.trim(kind).lower() not in ("text/html", "application/xhtml+xml"):
        return False
    return all(not T.trim(p) or re.fullmatch(r"[\w!#$%&'*+.^`|~-]+\s*=\s*(?:[\w!#$%&'*+.^`|~-]+|\"[^\"]*\")", T.trim(p), re.A) for p in params)


def decode(body: bytes, content_type: str | None) -> str:
    """Text of a body: by byte-order mark, header, or a meta tag near the start; else UTF-8 if it is, else Windows-1252."""
    for mark, cs in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if body.startswith(mark):
            return body[len(mark) :].decode(cs, "replace")
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I) or re.search(rb"<meta[^>]*charset\s*=\s*[\"']?([\w.:-]+)", body[:1024], re.I)
    if m:
        name = m[1].decode() if isinstance(m[1], bytes) else m[1]
        name = "cp1252" if name.lower() in ("iso-8859-1", "latin1", "ascii", "us-ascii", "windows-1252") else name
        try:
            return body.decode(name, "replace")
        except LookupError:
            pass
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("cp1252", "replace")


#: Columns of the metrics, in order, with their types.
FIELDS = {
    "title": "string", "title_status": "string", "title_truncated": "boolean", "title_original_length": "int",
    "description": "string", "description_status": "string",
    "h1": "string", "h1_count": "int", "h1_truncated": "boolean", "h1_original_length": "int", "h2_h6_status": "string",
    "og_title": "string", "og_title_truncated": "boolean", "og_title_original_length": "int", "og_description": "string",
    "og_image": "string", "og_image_truncated": "boolean", "og_image_original_length": "int",
    "twitter_card": "string", "twitter_card_truncated": "boolean", "twitter_card_original_length": "int",
    "internal_links": "int", "external_links": "int", "links": "int",
    "canonical_url": "string", "canonical_url_truncated": "boolean", "canonical_url_original_length": "int", "is_self_canonical": "boolean",
    "meta_robots": "string", "meta_robots_truncated": "boolean", "meta_robots_original_length": "int",
    "x_robots_tag": "string", "x_robots_tag_truncated": "boolean", "x_robots_tag_original_length": "int",
    "has_json_ld": "boolean", "has_viewport": "boolean", "total_images": "int", "images_missing_alt": "int", "word_count": "int",
}
EMPTY = {k: {"string": "", "int": 0, "boolean": False}[t] for k, t in FIELDS.items()}


def _target(url: str) -> U.Url | None:
    try:
        return U.parse(url)
    except U.UrlError:
        return None


class Fold:
    """Metrics of one page. Tags go to methods named after them; `hidden` counts open inert templates."""

    def __init__(self, url: str) -> None:
        self.out = dict(EMPTY)
        self.target = self.base = _target(url)
        self.based = False
        self.head = True
        self.templates: list[bool] = []  # of each open template: whether it is a shadow root
        self.muted = 0  # open script and style elements
        self.stray_titles = 0
        self.levels = dict.fromkeys(range(2, 7), 0)
        self.relative = 0
        self.once: set[str] = set()
        self.robots = Directives()
        self.canonical = ""
        self.title: list[str] | None = None
        self.first_h1: list[str] | None = None
        self.parts: list[str] = []
        self.sink_title = self.sink_h1 = False

    @property
    def hidden(self) -> bool:
        return not all(self.templates)

    @property
    def in_head(self) -> bool:
        return self.head and not self.templates

    def feed(self, m: Markup) -> None:
        if m.kind == "text":
            self.text(m.text)
        elif m.kind == "end":
            self.end(m.name)
        else:
            self.start(m.name, m.attrs)
            if m.closed:
                self.end(m.name)

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name == "template":
            mode = T.trim(attrs.get("shadowrootmode", "")).lower()
            self.templates.append(not self.head and not self.hidden and mode in ("open", "closed"))
            return
        if self.hidden:
            return
        if self.in_head and name not in HEAD_TAGS:
            self.head = False
        if name in ("h2", "h3", "h4", "h5", "h6"):
            self.levels[int(name[1])] += 1
        else:
            getattr(self, f"on_{name}", lambda a: None)(attrs) if name.isalnum() else None

    def end(self, name: str) -> None:
        if name == "template":
            if self.templates:
                self.templates.pop()
        elif not self.hidden:
            if name == "title":
                if self.sink_title:
                    self.sink_title = False
                else:
                    self.stray_titles = max(0, self.stray_titles - 1)
            elif name == "h1":
                self.sink_h1 = False
            elif name == "head":
                self.head = False
            elif name in ("script", "style"):
                self.muted = max(0, self.muted - 1)

    def text(self, s: str) -> None:
        if self.hidden:
            return
        silent = self.muted or self.stray_titles or self.sink_title
        if self.in_head and not silent and T.trim(s):
            self.head = False
        if self.sink_title:
            self.title.append(s)
        if self.sink_h1:
            self.first_h1.append(s)
        if not self.head and not silent:
            self.parts.append(s)

    def on_title(self, a) -> None:
        if not self.in_head:
            self.stray_titles += 1
        elif self.title is None:
            self.title, self.sink_title = [], True

    def on_h1(self, a) -> None:
        self.out["h1_count"] += 1
        if self.first_h1 is None:
            self.first_h1, self.sink_h1 = [], True

    def on_base(self, a) -> None:
        if not self.in_head or "href" not in a or self.based or self.target is None:
            return
        try:
            u = U.resolve(self.target, U.parse(T.trim(a["href"])))
        except U.UrlError:
            return
        if U.is_web(u):
            self.base, self.based = U.replace(u, fragment=""), True

    def on_link(self, a) -> None:
        if self.in_head and "href" in a and "canonical" in re.split(f"{T.SPACE_CLASS}+", a.get("rel", "").lower()) and self._first("canonical"):
            self.canonical = T.trim(a["href"])
            self._keep("canonical_url", self.canonical, "url")

    def on_script(self, a) -> None:
        self.muted += 1
        if not self.templates and T.trim(a.get("type", "")).lower() == "application/ld+json":
            self.out["has_json_ld"] = True

    def on_style(self, a) -> None:
        self.muted += 1

    def on_img(self, a) -> None:
        self.out["total_images"] += 1
        self.out["images_missing_alt"] += not T.trim(a.get("alt", ""))

    def on_a(self, a) -> None:
        href = T.trim(a.get("href", ""))
        if not href or href[0] == "#":
            return
        try:
            u = U.parse(href)
        except U.UrlError:
            return
        if u.scheme not in ("", "http", "https"):
            return
        if not u.host:
            self.relative += not u.scheme
            return
        same = self.target is not None and U.lenient_authority(u) == U.lenient_authority(self.target)
        self.out["internal_links" if same else "external_links"] += 1

    def on_meta(self, a) -> None:
        if self.templates:
            return
        name, content = T.trim(a.get("name", "")).lower(), a.get("content")
        if name == "robots" and content is not None:
            self.robots.add(content)
        if not self.head:
            return
        if name in ("description", "twitter:card") and self._first(name):
            if name == "description":
                self.out["description"] = T.bounded(T.trim(content or ""), T.BOUNDS["description"])[0]
            else:
                self._keep("twitter_card", T.trim(content or ""), "twitter_card")
        elif name == "viewport":
            self.out["has_viewport"] = True
        prop = T.trim(a.get("property", "")).lower()
        if content is not None and prop in ("og:title", "og:description", "og:image") and self._first(prop):
            if prop == "og:description":
                self.out["og_description"] = T.bounded(T.trim(content), T.BOUNDS["description"])[0]
            else:
                self._keep(prop.replace(":", "_"), T.trim(content), "title" if prop == "og:title" else "url")

    def _first(self, what: str) -> bool:
        fresh = what not in self.once
        self.once.add(what)
        return fresh

    def _keep(self, field: str, value: str, bound: str) -> None:
        self.out[field], self.out[f"{field}_truncated"], self.out[f"{field}_original_length"] = T.bounded(value, T.BOUNDS[bound])

    def close(self) -> dict:
        """What only the whole page tells."""
        o = self.out
        self._keep("meta_robots", str(self.robots), "robots")
        title = T.trim("".join(self.title or ()))
        self._keep("title", title, "title")
        o["title_status"] = T.length_status(len(title), T.TITLE_LIMITS)
        o["description_status"] = T.length_status(len(o["description"]), T.DESCRIPTION_LIMITS)
        if o["h1_count"]:
            self._keep("h1", T.trim("".join(self.first_h1)), "h1")
        else:
            o["h1"] = "[Missing H1]"
        o["h2_h6_status"] = ", ".join(f"H{k}:{n}" for k, n in self.levels.items() if n) or "No sub-headers (H2-H6)"
        inside = self.target is not None and self.base is not None and U.lenient_authority(self.base) == U.lenient_authority(self.target)
        o["internal_links" if inside else "external_links"] += self.relative
        o["links"] = o["internal_links"] + o["external_links"]
        o["is_self_canonical"] = U.is_self_canonical(self.canonical, self.target, self.base)
        o["word_count"] = T.words(self.parts)
        return o


def parse_page(status: int, body: bytes, url: str, content_type: str | None = "text/html; charset=utf-8", x_robots: list[str] = (), max_body: int = 5 << 20, max_token: int = 512 << 10, bare: bool = True) -> tuple[dict, str]:
    """Metrics of a response, and an error text (empty if all went well). After an error the metrics found so far stay.
    bare: see scan()."""
    fold = Fold(url)
    fold.out["x_robots_tag"], fold.out["x_robots_tag_truncated"], fold.out["x_robots_tag_original_length"] = header_directives(list(x_robots))
    if status != 200:
        return fold.out, ""
    if max_body <= 0 or max_token <= 0:
        return fold.out, "limits must be positive"
    over = len(body) > max_body
    try:
        for m in scan(decode(body[: max_body + 1], content_type), min(max_token, max_body + 1), bare):
            fold.feed(m)
    except PageError as e:
        return fold.out, str(e)
    return (fold.out, f"response body exceeds configured limit of {max_body} bytes") if over else (fold.close(), "")
