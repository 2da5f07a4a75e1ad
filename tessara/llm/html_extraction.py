"""HTML main-text extraction by wrapper inference over pages of the same host.

A page's tag stream gives a skeleton: its block elements, with runs of equal
siblings or groups of siblings folded into repeated groups, and a slot where an
element holds text. The skeletons of a host are aligned one after another: what
both have is merged, what only one has becomes optional, so the host's wrapper
is a regular expression without unions. Slots are then ranked by where they
stand in the wrapper, slots that say the same on all pages are told from those
that vary, and each page's text is taken from the slots of the best rank that
the page fills. Where no article, main or content element tells, the wrapper
does: its repeated groups of links are menus.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize

#: Skeletons of a host are first aligned in so many parts.
SALTS = 16
#: Longest group of siblings that is looked at for repetition.
GROUP = 3
#: Elements at either end of a deeply nested path.
DEPTH = 60
#: The share of a repeated slot's characters inside links from which it is a menu.
LINKED = 0.8
#: The rank of slots in no known container.
LAST = 3
#: Different pages that must agree before a slot's text counts as the host's own.
CONSTANT_PAGES = 3
#: The share of a slot's different pages that must agree as well.
CONSTANT_SHARE = 0.9

# HTML's element names, and words that sites give to what is not the main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select option button svg object canvas audio video head title annotation annotation-xml".split())
#: Of these, what follows an open one that is never closed is not its content.
SOFT = frozenset("select option button svg object canvas audio video annotation annotation-xml".split())
BLOCKS = frozenset("html body p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd div section article main blockquote pre table thead tbody tfoot tr td th caption figure figcaption header footer nav aside form fieldset address details summary dialog center menu search hgroup".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "caption", "thead", "tbody", "tfoot"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
AWAY = frozenset("nav footer aside form header dialog menu search fieldset".split())
AWAY_WORDS = frozenset(
    "ad ads adv adbanner adbox adsbygoogle adslot adspace adunit advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert menu nav navbar navigation"
    " breadcrumb breadcrumbs sidebar side widget header masthead topbar footer comment comments commentlist reply replies respond disqus discussion share sharing social related recommended"
    " newsletter subscribe subscription signup login search searchbox popup modal overlay toolbar pagination pager copyright complementary contentinfo form skip".split()
)
#: Of AWAY_WORDS, those that must be a class or id of their own, not a part of one.
WHOLE_WORDS = frozenset("side form discussion".split())
HOLDERS = frozenset("article main".split())
HOLDER_WORDS = frozenset("article articlebody content maincontent post postbody entry story main".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_UNSHOWN = re.compile(r"""\bstyle\s*=\s*(?:"[^"]*display\s*:\s*none|'[^']*display\s*:\s*none|display:none)""", re.I)
#: What a class says of the state or the surroundings of its element, such as has-sidebar.
_STATE = re.compile(r"^(?:has|is|no|with|without|long|full)[-_]|[-_](?:layout|page|template|wrapper|container)$", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def tag_stream(page: str):
    """("open", name, attributes), ("close", name, "") and ("text", text, "") in page order.

    Comments, declarations and the content of elements that hold no prose are left out.
    """
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):  # a tag that never ends
                return
            yield "text", "<", ""
            at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            yield "close", name, ""
        elif name in SOFT:
            end = re.compile(rf"<(/?){re.escape(name)}(?=[\s>/])", re.I).search(page, at)
            if end and end[1] and not m[3].rstrip().endswith("/"):
                close = page.find(">", end.end())
                at = n if close < 0 else close + 1
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s>/]" if name != "head" else r"</head[\s>/]|(?=<body[\s>])", re.I).search(page, at)
            if end:
                close = page.find(">", end.start())
                at = end.start() if page[end.start() : end.start() + 5].lower() == "<body" else (n if close < 0 else close + 1)
            elif name != "head":
                return
        else:
            yield "open", name, m[3]


def label(name: str, attributes: str) -> str:
    """An element's name in the wrapper: its tag, and the words of its class, id and role.

    ``-`` before it tells what is never main text, ``+`` what holds main text.
    """
    words: list[str] = []
    told: set[str] = set()
    if attributes:
        for m in _NAMED.finditer(attributes):
            for given in (m[2] or m[3] or m[4] or "").split():
                own = _WORD.findall(_CAMEL.sub(" ", given).lower())
                words += own
                if name in HOLDERS or len(own) == 1:
                    told.update(own if len(own) == 1 else ())
                elif not _STATE.search(given):
                    told.update(w for w in own if w not in WHOLE_WORDS)
    hidden = bool(attributes) and bool(_HIDDEN.search(_QUOTED.sub("", attributes)) or _UNSHOWN.search(attributes))
    away = name not in ("html", "body") and (hidden or bool(AWAY_WORDS & told) or name in AWAY)
    sign = "-" if away else "+" if name in HOLDERS else "*" if HOLDER_WORDS.intersection(words) and name not in ("html", "body") else ""
    return sign + ".".join([name, *words[:4]])


def path_of(labels: list[str]) -> str:
    """Labels from the root; one for a run of equal labels. Of more than 2 * DEPTH the plain ones between go."""
    parts = [x for k, x in enumerate(labels) if not k or labels[k - 1] != x]
    if len(parts) > 2 * DEPTH:
        inner = [x for x in parts[DEPTH:-DEPTH] if x[0] in "+-*"]
        parts = [*parts[:DEPTH], *dict.fromkeys(inner), *parts[-DEPTH:]]
    return "/".join(parts)


def closed(events: list[tuple[str, str, str]]) -> set[int]:
    """Numbers of the elements, in the order they open, that a tag of their own closes."""
    opened: dict[str, list[int]] = {}
    stack: list[tuple[str, int]] = []
    out, k = set(), 0
    for kind, name, _ in events:
        if kind == "open" and name not in VOID:
            stack.append((name, k))
            opened.setdefault(name, []).append(k)
            k += 1
        elif kind == "close" and opened.get(name):
            while True:
                own, at = stack.pop()
                opened[own].pop()
                if own == name:
                    out.add(at)
                    break
    return out


def linked_blocks(page: str | None):
    """(path, text, characters inside links) of each run of text of one block element, in page order; text is decoded and trimmed."""
    events = list(tag_stream(page or ""))
    ended = closed(events)
    stack: list[tuple[str, str, bool]] = []
    held: list[str] = []
    out: list[tuple[str, str, int]] = []
    number, link, linked = 0, False, 0

    def flush():
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((path_of([x for _, x, _ in stack]), text, min(linked, len(text))))
            held.clear()
        linked = 0

    for kind, name, attributes in events:
        own_closed = False
        if kind == "open" and name not in VOID:
            own_closed = number in ended
            number += 1
        if kind == "text":
            held.append(name)
            linked += len(name) if link else 0
        elif name == "a":
            link = kind == "open"
        elif name == "br":
            held.append(" ")
        elif name in VOID:
            if name == "hr":
                flush()
        elif name not in BLOCKS:
            if kind == "open" and attributes and label(name, attributes).startswith("-"):
                flush()  # an inline advert or notice is a block of its own
                stack.append((name, label(name, attributes), own_closed))
            elif kind == "close" and any(n == name for n, _, _ in stack):
                flush()
                while stack.pop()[0] != name:
                    pass
        elif kind == "open":
            flush()
            own = label(name, attributes)
            if name in CLOSES_P:
                while stack and stack[-1][0] in ("p", *HEADINGS) or stack and stack[-1][0] not in BLOCKS and any(n == "p" for n, _, _ in stack):
                    stack.pop()
            if name in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                stack.pop()
            if own.startswith("+") and any(x.startswith("-") and not e for _, x, e in stack):  # an advert or menu that nothing closed ends here
                first = next(k for k, (_, x, e) in enumerate(stack) if x.startswith("-") and not e)
                if not any(x.startswith("+") for _, x, _ in stack[:first]):
                    stack[first:] = []
            if name in ("html", "body") and any(n == name for n, _, _ in stack):
                continue
            stack.append((name, own, own_closed))
        else:
            flush()
            if any(n == name for n, _, _ in stack):
                while stack.pop()[0] != name:
                    pass
    flush()
    return out


def blocks(page: str | None):
    """(path, text) of each run of text of one block element, in page order."""
    return [(p, t) for p, t, _ in linked_blocks(page)]


# A wrapper's element is [label, times, children]; times is "" (once), "?", "+" or "*".


def merged_times(a: str, b: str) -> str:
    less, more = "?" in (a, b) or "*" in (a, b), "+" in (a, b) or "*" in (a, b)
    return "*" if less and more else "+" if more else "?" if less else ""


def align(a: list, b: list) -> list:
    """Two lists of siblings as one: equal labels in order are merged, the others become optional."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    optional = lambda e: [e[0], merged_times(e[1], "?"), e[2]]
    while i < n and j < m:
        if a[i][0] == b[j][0]:
            out.append([a[i][0], merged_times(a[i][1], b[j][1]), align(a[i][2], b[j][2])])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return fold(out + [optional(e) for e in a[i:]] + [optional(e) for e in b[j:]])


def fold(siblings: list) -> list:
    """Neighbouring repeats of a group of up to GROUP siblings become one repeated group."""
    out = siblings
    for size in range(1, GROUP + 1):
        done: list = []
        for e in out:
            done.append(e)
            while len(done) >= 2 * size and [x[0] for x in done[-size:]] == [x[0] for x in done[-2 * size : -size]]:
                last = done[-size:]
                del done[-size:]
                for k in range(size):
                    old, new = done[k - size], last[k]
                    done[k - size] = [old[0], merged_times(merged_times(old[1], new[1]), "+"), align(old[2], new[2])]
        out = done
    return out


def skeleton(found: list[tuple[str, str]]) -> list:
    """The page's elements that hold text, as a wrapper of that page alone."""
    root: list = []
    opened: list[tuple[str, list]] = []
    for path, _ in found:
        parts = path.split("/") if path else []
        same = 0
        while same < min(len(parts), len(opened)) and opened[same][0] == parts[same]:
            same += 1
        if same == len(parts) and same and parts:  # another text of the same label is a sibling
            same -= 1
        del opened[same:]
        for part in parts[same:]:
            inside = opened[-1][1] if opened else root
            children: list = []
            inside.append([part, "", children])
            opened.append((part, children))
        inside = opened[-1][1] if opened else root
        inside.append(["#", "", []])

    def folded(elements: list) -> list:
        return fold([[name, times, folded(children)] for name, times, children in elements])

    return folded(root)


def slots(wrapper: list, path: str = "", repeated: bool = False) -> dict[str, tuple[int | None, bool]]:
    """By path, each text slot's rank (None for what is never main text), and whether it is in a repeated group of the wrapper."""
    out: dict[str, tuple[int | None, bool]] = {}
    for name, times, children in wrapper:
        again = repeated or times in ("+", "*")
        own = {path: (slot_rank(path), again)} if name == "#" else slots(children, f"{path}/{name}" if path else name, again)
        for p, (rank, r) in own.items():
            out[p] = rank, r or out.get(p, (None, False))[1]
    return out


def slot_rank(path: str) -> int | None:
    """0 in an article, 1 in the main element, 2 in what is named as content, LAST elsewhere.

    What stands in a menu, a notice or comments is None, an article too; of an
    article's own header its headings are kept.
    """
    parts = path.split("/")
    holder = max((k for k, p in enumerate(parts) if p.startswith("+")), default=-1)
    away = [k for k, p in enumerate(parts) if p.startswith("-")]
    rank = 2 if any(p.startswith("*") for p in parts) else LAST
    if holder >= 0:
        rank = 0 if any(p.startswith("+article") for p in parts) else 1
    if away:
        titled = 0 <= holder < away[0] and len(away) == 1 and "header" in re.split(r"[-.]", parts[away[0]]) and parts[-1].split(".")[0] in HEADINGS
        return rank if titled else None
    return rank


def main_text(found: list[tuple[str, str, int]], rank: dict[str, tuple[int | None, bool]], same: set[tuple[str, int]]) -> list[str]:
    """The texts of a page's best slots.

    Without a known container, the wrapper decides: slots of its repeated groups
    that hold hardly anything but links are menus, and slots that say the same
    on the host's pages (``same``) are the host's own. Neither empties a page.
    """
    known = [(rank.get(p, (slot_rank(p), False)), p, t, n) for p, t, n in found]
    best = min((r for (r, _), _, _, _ in known if r is not None), default=None)
    if best is None:  # everything stands in what looks like a menu: an article in it is taken after all
        inside = [(p[p.rindex("+") :], t) for p, t, _ in found if "+" in p]
        return [t for p, t in inside if slot_rank(p) is not None]
    taken = [(again, p, t, n) for (r, again), p, t, n in known if r == best]
    if best == LAST:
        size, links = {}, {}
        for again, p, t, n in taken:
            size[p] = size.get(p, 0) + len(t)
            links[p] = links.get(p, 0) + n
        taken = [x for x in taken if not (x[0] and links[x[1]] >= LINKED * size[x[1]])] or taken
        gone = {p for p, _ in same & set(said_by([(p, t) for _, p, t, _ in taken]).items())}
        taken = [x for x in taken if x[1] not in gone] or taken
    return [t for _, _, t, _ in taken]


def rendered(wrapper: list) -> str:
    """The wrapper as a regular expression over elements, for reading."""
    return " ".join("#text" + times if name == "#" else f"({name}: {rendered(children)}){times}" if children else name + times for name, times, children in wrapper)


def key_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def said_by(found: list[tuple[str, str]]) -> dict[str, int]:
    """The key of what a page says in each slot in no known container."""
    texts: dict[str, list[str]] = {}
    for p, t in found:
        texts.setdefault(p, []).append(t)
    return {p: key_of(" ".join(t)) for p, t in texts.items() if slot_rank(p) == LAST}


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), constant (paths of slots that say the same on nearly all pages), common (keys of what they say) of each host.

    Copies of a page are one page: pages are told apart by their whole content.

    Equal skeletons are counted before they meet, so a host of very many pages
    brings no more rows than it has layouts; those are aligned in SALTS parts,
    then the parts.
    """
    source = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))

    def read(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                host, said, layout, path, own = [], [], [], [], []
                for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    found = blocks(page)
                    texts = said_by(found)
                    host += [h] * (len(texts) + 1)
                    layout += [json.dumps(skeleton(found), separators=(",", ":")), *[None] * len(texts)]
                    path += [None, *texts]
                    said += [None, *texts.values()]
                    own += [None, *[key_of(page or "") if texts else None] * len(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(layout, pa.string()), pa.array(path, pa.string()), pa.array(said, pa.int64()), pa.array(own, pa.int64())], names=["host", "layout", "path", "said", "own"])

    rows = source.mapInArrow(read, "host string, layout string, path string, said bigint, own bigint")
    counted = materialize(rows.distinct().groupBy("host", "layout", "path", "said").agg(F.count(F.lit(1)).alias("n")))
    layouts = counted.where("layout is not null").select("host", F.pmod(F.xxhash64("layout"), F.lit(SALTS)).cast("int").alias("salt"), "layout")

    def fold_all(rows: DataFrame, keys: list[str]) -> DataFrame:
        def run(batches):
            at, wrapper = None, None
            for batch in batches:
                for *key, layout in zip(*(batch.column(c).to_pylist() for c in (*keys, "layout"))):
                    if at is not None and key == at:
                        wrapper = align(wrapper, json.loads(layout))
                    else:
                        if at is not None:
                            yield pa.RecordBatch.from_pylist([{"host": at[0], "layout": json.dumps(wrapper, separators=(",", ":"))}])
                        at, wrapper = key, json.loads(layout)
            if at is not None:
                yield pa.RecordBatch.from_pylist([{"host": at[0], "layout": json.dumps(wrapper, separators=(",", ":"))}])

        return rows.repartition(*keys).sortWithinPartitions(*keys, "layout").select(*keys, "layout").mapInArrow(run, "host string, layout string")

    wrappers = fold_all(fold_all(layouts, ["host", "salt"]), ["host"])
    most = counted.where("path is not null").groupBy("host", "path").agg(F.max(F.struct("n", "said")).alias("most"), F.sum("n").alias("all"))
    most = most.where((F.col("most.n") >= CONSTANT_PAGES) & (F.col("most.n") >= CONSTANT_SHARE * F.col("all")))
    constant = most.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "most.said"))).alias("most"))
    return wrappers.join(constant, "host", "left").select("host", F.col("layout").alias("wrapper"), F.coalesce("most.path", F.array().cast("array<string>")).alias("constant"), F.coalesce("most.said", F.array().cast("array<bigint>")).alias("common"))


def host_of(url):
    """The host of a URL; empty for null and for what has none."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages have an empty text; pages whose url is null or has no
    host share one wrapper; repeated rows give repeated rows; other columns are
    not read; an empty table gives no rows. Nothing is dropped from a slot that
    is taken, and no text is cut. Of a page without known containers, slots go
    that say what nearly all of the host's different pages say there, unless
    nothing would be left of the page.
    """
    wrappers = materialize(infer_wrappers(pages))
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    rows = join_small(source, wrappers, ["host"]).select("page_id", "url", "html", "wrapper", "constant", "common")

    def run(batches):
        ranks: dict[str, dict[str, int]] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part, texts = batch.slice(a, 256), []
                for page, wrapper, constant, common in zip(*(part.column(c).to_pylist() for c in ("html", "wrapper", "constant", "common"))):
                    if wrapper not in ranks:
                        if len(ranks) > 1000:
                            ranks.clear()
                        ranks[wrapper] = slots(json.loads(wrapper))
                    texts.append(" ".join(main_text(linked_blocks(page), ranks[wrapper], set(zip(constant, common)))))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [f"{c} {source.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"{', '.join(kinds)}, text string, n_chars bigint")
