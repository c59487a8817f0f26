"""Options of rendered fetches: validation, stealth switches and block patterns. Rendering itself is
done elsewhere; here options are checked and turned into plain data and predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import urls

# What options may be.
PROXY_SCHEMES = ("http", "https", "socks4", "socks5")
REMOTE_SCHEMES = ("http", "https", "ws", "wss")
WAIT_STATES = ("", "attached", "detached", "hidden", "visible")
ACTIONS = {"click": "selector", "fill": "selector", "wait_for_selector": "selector", "evaluate": "script"}
# Extensions of resources that aren't loaded if resources are switched off, and ad domains.
RESOURCES = ("avif", "css", "gif", "ico", "jpg", "jpeg", "mp3", "mp4", "png", "svg", "ttf", "webm", "webp", "woff", "woff2")
AD_DOMAINS = ("2mdn.net", "doubleclick.net", "google-analytics.com", "googlesyndication.com", "googletagmanager.com")


@dataclass(frozen=True)
class Stealth:
    """Switches of stealth; any of them implies ``enabled``. Solving challenges is refused."""

    enabled: bool = False
    generate_headers: bool = False
    google_referer: bool = False
    hide_canvas: bool = False
    block_webrtc: bool = False
    disable_webgl: bool = False
    solve_challenge: bool = False

    def normalised(self) -> Stealth:
        return replace(self, enabled=any(vars(self).values()))

    def merged(self, other: Stealth) -> Stealth:
        """Both together: what either switches on is on."""
        a, b = vars(self.normalised()), vars(other.normalised())
        return Stealth(**{k: a[k] or b[k] for k in a})

    def flags(self, given: tuple[str, ...] = ()) -> list[str]:
        """Launch flags, each once."""
        own = self.normalised()
        wanted = [*given]
        # Flags of the browser.
        for on, flag in ((own.block_webrtc, "--force-webrtc-ip-handling-policy=disable_non_proxied_udp"), (own.disable_webgl, "--disable-features=WebGL,WebGL2")):
            if on:
                wanted.append(flag)
        return list(dict.fromkeys(wanted))


@dataclass(frozen=True)
class Options:
    """Options of a rendered fetch. Actions are (kind, selector, value)."""

    proxy: str = ""
    proxy_user: str = ""
    remote: str = ""
    extra_flags: tuple[str, ...] = ()
    wait_state: str = ""
    actions: tuple[tuple[str, str, str], ...] = ()
    capture_xhr: str = ""
    screenshot_quality: int | None = None
    screenshot_selector: str = ""
    screenshot_full_page: bool = False
    user_agent: str = ""
    locale: str = ""
    stealth: Stealth = field(default_factory=Stealth)


def problems(o: Options) -> list[str]:
    """All that is wrong with options; none is an empty list."""
    out: list[str] = []

    def address(text: str, schemes: tuple[str, ...], name: str) -> None:
        u = urls.parse_url(text)
        if u is None or not u.host:
            out.append(f"invalid {name}")
        elif u.scheme not in schemes:
            out.append(f"unsupported {name} scheme")

    if o.stealth.solve_challenge:
        out.append("solving challenges isn't supported")
    if o.proxy:
        address(o.proxy, PROXY_SCHEMES, "proxy")
    elif o.proxy_user:
        out.append("proxy credentials need a proxy")
    if o.remote:
        address(o.remote, REMOTE_SCHEMES, "remote address")
    if any(not f.strip() for f in o.extra_flags):
        out.append("empty flag")
    if o.wait_state not in WAIT_STATES:
        out.append("unsupported wait state")
    for kind, selector, value in o.actions:
        need = ACTIONS.get(kind)
        if need is None:
            out.append(f"unsupported action {kind}")
        elif need and not (selector if need == "selector" else value).strip():
            out.append(f"action {kind} needs a {need}")
    try:
        re.compile(o.capture_xhr)
    except re.error:
        out.append("invalid pattern of captured requests")
    if o.screenshot_quality is not None:
        if not 0 <= o.screenshot_quality <= 100:
            out.append("quality must lie between 0 and 100")
        if o.screenshot_selector.strip() and o.screenshot_full_page:
            out.append("a selector and the full page exclude each other")
    if re.search(r"[\r\n]", o.user_agent + o.locale):
        out.append("line breaks in header values")
    return out


def _named(domains: list[str], ads: bool) -> list[str]:
    bare = (d.strip().lower().strip(".") for d in [*domains, *(AD_DOMAINS if ads else ())])
    return [d for d in bare if d]


def block_patterns(domains: list[str], resources: bool = False, ads: bool = False) -> list[str]:
    """Patterns of what isn't loaded, each once, sorted: two for each domain, one for each resource."""
    found = {p for d in _named(domains, ads) for p in (f"*://{d}/*", f"*://*.{d}/*")}
    return sorted(found | ({f"*://*:*/*.{x}" for x in RESOURCES} if resources else set()))


def blocked(url: Column, domains: list[str], resources: bool = False, ads: bool = False) -> Column:
    """Whether a URL isn't loaded: its host is a domain or under one, or its extension is a resource's."""
    host = F.regexp_replace(urls.host(url), r"\.$", "")
    out = urls.domain_in(host, _named(domains, ads))
    if resources:
        path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
        out = out | urls.extension(path).isin(*RESOURCES)
    return F.coalesce(out, F.lit(False))
