"""Strict URLs: parse, resolve, format; host and authority keys; targets that must not be fetched."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, replace
from urllib.parse import quote_plus

from .text import trim

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_HOST_BAD = re.compile(r"[\x00-\x20\"<>\\^`{|}\x7f/?#@]")
_HEX = "0123456789ABCDEF"


class UrlError(ValueError):
    """The text is no URL, or no allowed target."""


def _unescape(s: str, plus: bool = False) -> str:
    if _BAD_ESCAPE.search(s):
        raise UrlError("invalid URL escape")
    if plus:
        s = s.replace("+", " ")
    if "%" not in s:
        return s
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), s.encode("utf-8", "surrogateescape"))
    return raw.decode("utf-8", "surrogateescape")


def _escape(s: str, safe: str) -> str:
    out = []
    for b in s.encode("utf-8", "surrogateescape"):
        c = chr(b)
        out.append(c if b < 128 and (c.isalnum() or c in "-_.~" or c in safe) else f"%{_HEX[b >> 4]}{_HEX[b & 15]}")
    return "".join(out)


_PATH_SAFE = "$&+,/:;=@"
_PATH_KEPT = re.compile(r"(?:[A-Za-z0-9\-_.~!$&'()*+,/:;=@\[\]]|%[0-9A-Fa-f]{2})*")


@dataclass(frozen=True)
class Url:
    scheme: str = ""
    opaque: str = ""
    user: str | None = None
    host: str = ""
    path: str = ""
    raw_path: str = ""  # the path as written, where formatting would write it otherwise
    query: str | None = None
    fragment: str = ""

    @property
    def absolute(self) -> bool:
        return bool(self.scheme)

    def escaped_path(self) -> str:
        if self.raw_path and _PATH_KEPT.fullmatch(self.raw_path):
            return self.raw_path
        return "*" if self.path == "*" else _escape(self.path, _PATH_SAFE)

    def hostname(self) -> str:
        h = self.host
        if h.startswith("["):
            return h[1 : h.index("]")] if "]" in h else h[1:]
        return h.rpartition(":")[0] if re.search(r":\d*$", h) else h

    def port(self) -> str:
        m = re.search(r"(?:^|\]|[^:\]]):(\d*)$", self.host)
        return m[1] if m else ""

    def __str__(self) -> str:
        out = f"{self.scheme}:" if self.scheme else ""
        if self.opaque:
            out += self.opaque
        else:
            path = self.escaped_path()
            if self.scheme or self.host or self.user is not None:
                if self.host or path or self.user is not None:
                    if self.host or self.user is not None or path.startswith("//"):
                        out += "//"
                    if self.user is not None:
                        out += self.user + "@"
                    if self.host:
                        out += _escape(self.host, "!$&'()*+,;=:[]<>\"") if not self.host.startswith("[") else self.host
            if path and not path.startswith("/") and self.host:
                out += "/"
            if not out and ":" in path.partition("/")[0]:
                out += "./"
            out += path
        if self.query is not None:
            out += "?" + self.query
        if self.fragment:
            out += "#" + _escape(self.fragment, _PATH_SAFE + "!()*?'")
        return out


def parse(raw: str) -> Url:
    """URL of a text, absolute or relative. Raises UrlError."""
    if any(ord(c) < 32 or ord(c) == 127 for c in raw):
        raise UrlError("control character in URL")
    rest, _, fragment = raw.partition("#")
    fragment = _unescape(fragment)
    if rest == "*":
        return Url(path="*", fragment=fragment)
    m = _SCHEME.match(rest)
    scheme = m[1].lower() if m else ""
    rest = rest[m.end() :] if m else rest
    if not m and rest.startswith(":"):
        raise UrlError("missing protocol scheme")
    rest, mark, query = rest.partition("?")
    q = query if mark else None
    if not rest.startswith("/"):
        if scheme:
            return Url(scheme, opaque=rest, query=q, fragment=fragment) if rest else Url(scheme, query=q, fragment=fragment)
        if ":" in rest.partition("/")[0]:
            raise UrlError("first path segment in URL cannot contain colon")
    user, host = None, ""
    if rest.startswith("//") and (scheme or not rest.startswith("///")):
        authority, slash, tail = rest[2:].partition("/")
        rest = slash + tail
        info, at, host = authority.rpartition("@")
        if at:
            if not re.fullmatch(r"[A-Za-z0-9\-._:~!$&'()*+,;=%@]*", info):
                raise UrlError("invalid userinfo")
            _unescape(info)
            user = info
        host = _host(host)
    path = _unescape(rest)
    return Url(scheme, "", user, host, path, rest if _escape(path, _PATH_SAFE) != rest else "", q, fragment)


def _host(host: str) -> str:
    if host.startswith("["):
        end = host.rfind("]")
        if end < 0:
            raise UrlError("missing ']' in host")
        tail = host[end + 1 :]
        if tail and not re.fullmatch(r":\d*", tail):
            raise UrlError("invalid port after host")
        return host
    name, colon, port = host.rpartition(":")
    if colon:
        if not re.fullmatch(r"\d*", port):
            raise UrlError("invalid port after host")
    if re.search(r"%(?![0-9A-Fa-f]{2})", host):
        raise UrlError("invalid URL escape")
    if re.search(r"%[0-7][0-9A-Fa-f]", host):  # only bytes beyond ASCII may be escaped in a host
        raise UrlError("invalid URL escape in host")
    if _HOST_BAD.search(host):
        raise UrlError("invalid character in host name")
    return _unescape(host)


def resolve(base: Url, ref: Url) -> Url:
    """The reference seen from the base (RFC 3986, section 5.2)."""
    if ref.scheme or ref.host or ref.user is not None:
        out = replace(ref, scheme=ref.scheme or base.scheme)
        return out if out.opaque else _dotless(out, out.escaped_path())
    if ref.opaque:
        return replace(ref, scheme=base.scheme, user=None, host="")
    out = replace(ref, scheme=base.scheme, user=base.user, host=base.host)
    if not ref.path and ref.query is None:
        out = replace(out, query=base.query, fragment=ref.fragment or base.fragment)
    if not ref.path and base.opaque:
        return replace(out, opaque=base.opaque, user=None, host="", path="", raw_path="")
    path = ref.escaped_path()
    if not path:
        path = base.escaped_path()
    elif not path.startswith("/"):
        path = base.escaped_path().rpartition("/")[0] + "/" + path
    return _dotless(out, path)


def _dotless(u: Url, path: str) -> Url:
    kept: list[str] = []
    parts = path.split("/")
    for p in parts:
        if p == "..":
            if kept:
                kept.pop()
        elif p != ".":
            kept.append(p)
    if not path:
        return replace(u, path="", raw_path="")
    if parts[-1] in (".", ".."):
        kept.append("")
    written = "/" + "/".join(kept).lstrip("/")
    plain = _unescape(written)
    return replace(u, path=plain, raw_path=written if _escape(plain, _PATH_SAFE) != written else "")


def query_pairs(query: str | None) -> dict[str, list[str]]:
    """Values by key; pairs with a semicolon or a bad escape are left out."""
    out: dict[str, list[str]] = {}
    for pair in (query or "").split("&"):
        if not pair or ";" in pair:
            continue
        k, _, v = pair.partition("=")
        try:
            out.setdefault(_unescape(k, True), []).append(_unescape(v, True))
        except UrlError:
            continue
    return out


def encode_query(pairs: dict[str, list[str]]) -> str:
    """Form encoding, by key."""
    f = lambda s: quote_plus(s.encode("utf-8", "surrogateescape"), safe="-_.~")
    return "&".join(f"{f(k)}={f(v)}" for k in sorted(pairs, key=lambda k: k.encode("utf-8", "surrogateescape")) for v in pairs[k])


def _ip(host: str):
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return None
    return ip.ipv4_mapped or ip if ip.version == 6 else ip


def hostname_key(host: str) -> str:
    """One spelling for equal DNS names and addresses."""
    host = trim(host).removesuffix(".")
    if not host:
        raise UrlError("empty hostname")
    ip = _ip(host)
    if ip is not None:
        return str(ip)
    if host.isascii():
        if not re.fullmatch(r"[A-Za-z0-9._-]+", host) or any(not p or len(p) > 63 for p in host.split(".")):
            raise UrlError("invalid hostname")
        if any(p.startswith("-") or p.endswith("-") for p in host.split(".")) or "_" in host:
            raise UrlError("invalid hostname")
        return host.lower()
    try:
        import idna

        return idna.encode(host, uts46=True, transitional=False).decode().lower()
    except ImportError:
        return host.encode("idna").decode().lower()
    except UnicodeError as e:
        raise UrlError(f"normalize hostname {host!r}") from e


def authority_key(u: Url) -> str:
    """Host key, with the port unless it is the scheme's own."""
    host, port = hostname_key(u.hostname()), u.port()
    if {"http": "80", "https": "443"}.get(u.scheme.lower()) == port:
        port = ""
    host = f"[{host}]" if ":" in host else host
    return f"{host}:{port}" if port else host


def lenient_authority(u: Url) -> str:
    try:
        return authority_key(u)
    except UrlError:
        return u.host.removesuffix(".").lower()


# Networks that must not be fetched.
BLOCKED = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "::/128", "::1/128", "100::/64", "2001::/23", "2001:2::/48", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10", "ff00::/8")]


def blocked_ip(text: str) -> bool:
    ip = _ip(text)
    return ip is None or any(ip in n for n in BLOCKED if n.version == ip.version)


def private_host(host: str) -> bool:
    name = re.sub(r":[^:\]]*$", "", host) if host.count(":") == 1 or host.startswith("[") else host
    name = name.removesuffix(".").lower().strip("[]")
    return name == "localhost" or name.endswith(".localhost") or (_ip(name) is not None and blocked_ip(name))


def resolved_ips_allowed(ips: list[str], allow_private: bool) -> bool:
    """Whether a host that resolves to these addresses may be fetched; no address is never allowed."""
    return bool(ips) and (allow_private or not any(map(blocked_ip, ips)))


def normalize_target(raw: str, allow_private: bool = False) -> str:
    """The URL to fetch, without its fragment. Raises UrlError for what is no target."""
    raw = trim(raw)
    if not raw:
        raise UrlError("empty URL")
    u = parse(raw)
    if u.scheme not in ("http", "https"):
        raise UrlError(f"unsupported URL scheme {u.scheme!r}")
    if not u.host:
        raise UrlError("missing host")
    if u.user is not None:
        raise UrlError("credentials in URL are not allowed")
    if not allow_private and private_host(u.host):
        raise UrlError("private or local targets are disabled")
    return str(replace(u, fragment=""))


def is_web(u: Url) -> bool:
    return bool(u.host) and u.scheme.lower() in ("http", "https")


def _canonical_form(u: Url) -> str:
    return str(replace(u, scheme=u.scheme.lower(), host=lenient_authority(u), fragment="", path=u.path or "/"))


def is_self_canonical(canonical: str, target: str | Url | None, base: Url | None = None) -> bool:
    """Whether the canonical link, seen from the base, is the target; query and closing slash count, the fragment doesn't."""
    try:
        target = parse(target) if isinstance(target, str) else target
        if not trim(canonical) or target is None:
            return False
        c = parse(canonical)
        c = c if c.absolute else resolve(base or target, c)
    except UrlError:
        return False
    return is_web(c) and _canonical_form(c) == _canonical_form(target)
