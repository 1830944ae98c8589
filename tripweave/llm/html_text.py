"""Operator 6, main text of web pages by wrappers that are inferred per host.

A page is read as a tree of block elements; its skeleton, a union-free regular expression, has
a leaf for each run of text, with a hash of it, and runs of like siblings folded into repeated
groups, whose texts are hashed together. Pages of a host are aligned: matching elements are
merged, elements without a partner become optional, adjacent repeats are folded again. A leaf
whose texts agree stays template text, with the number of pages that agree; at the first mismatch
it becomes a text slot. What is left is the host's wrapper, and it decides: fields in menus,
headers, footers, sidebars, notices, adverts, forms and comments are page furniture, as is,
outside of articles, a field that is template text of at least three pages. Slots and the texts
of fewer pages are content, those in an article before others.

Pages of one structure differ in their texts alone: they are merged leaf by leaf, in the tasks
that read them and then by grouped aggregation. Only the distinct structures of a host are
aligned, and never more than ``FAN`` at once: groups of a host are merged, then the results, until
one is left. Pages are read twice; they are not moved unless the rules of all hosts are large.

Defined results: a null or empty html has no text; a null url, or one without host, belongs to
a host of its own name, the empty one; broken markup is read leniently, as browsers do for
paragraphs and lists, to any depth; classes of html and body elements are not looked at; repeated
rows give repeated results; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized

#: Skeletons of a host that one call aligns.
FAN = 32
#: Pages that must agree on a text outside of articles for it to be furniture.
AGREE = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|math|textarea|select|title|object)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[^<]+|<",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS, _PARTS = re.compile(r"\d+"), re.compile(r"[^a-z0-9]+")
#: Elements that do not break a line of text. Fixed values of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without content, and what the start of an element closes. Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Elements, roles and parts of class names that mark page furniture.
FURNITURE_TAGS = frozenset("head nav header footer aside form menu dialog button fieldset".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer "
    "sidebar sidenav aside widget widgets related recommended comment comments respond reply "
    "disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social toolbar search "
    "contentinfo complementary skip copyright".split()
)
_MAIN = frozenset(["article", "main"])


def _label(tag: str, rest: str) -> str:
    names = [_DIGITS.sub("0", (a or b or c).lower()) for _, a, b, c in _NAMED.findall(rest)] if rest else []
    return f"{tag}.{' '.join(names)}" if names else tag


def blocks(page: str | None) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path of labels, text) of each run of text between borders of blocks, in page order."""
    stack: list[str] = []
    tags: list[str] = []
    text: list[str] = []

    def run():
        body = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        return [(tuple(stack), body)] if body else []

    for token in _TOKEN.finditer(page or ""):
        tag = token["tag"]
        if tag is None:
            piece = token[0]
            if token["raw"] is None and not piece.startswith(("<!", "<?")):
                text.append(piece)
            elif token["raw"]:
                text.append(" ")
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        if tag in VOID:
            text.append(" ")
            continue
        yield from run()
        if token["end"]:
            if tag in tags:
                at = len(tags) - 1 - tags[::-1].index(tag)
                del tags[at:], stack[at:]
            continue
        closes, within = CLOSES.get(tag, (set(), set()))
        for at in range(len(tags) - 1, -1, -1):
            if tags[at] in closes:
                del tags[at:], stack[at:]
            elif tags[at] == "p" or tags[at] not in within and closes and tags[at] in ("p", "div", "span"):
                if tags[at] != "p":
                    break
                del tags[at:], stack[at:]
            else:
                break
        tags.append(tag)
        stack.append(_label(tag, token["rest"]))
    yield from run()


# A wrapper is a list of parts [label, mark, parts, hash, pages]; the mark is "", "?", "+" or "*".
# A leaf is a part labelled "#": its hash is that of the text that all its pages agree on, null
# for a slot. A repeated group of several parts has the label "()". Functions on parts recurse as
# deep as the markup nests, for which Python's own limit is lifted.


def text_hash(*texts: object) -> int:
    body = "\n".join(map(str, texts)).encode()
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little") >> 1


def skeleton(texts: list[tuple[tuple[str, ...], str]]) -> list:
    """The tree of the (path, text) of a page, repeats folded."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
    root: list = []
    last: list[list] = []
    before: tuple[str, ...] = ()
    for path, text in texts:
        same = 0
        while same < min(len(path), len(before)) and path[same] == before[same]:
            same += 1
        if path and same == len(path) == len(before):
            same -= 1
        del last[same:]
        for label in path[same:]:
            part = [label, "", [], None, 0]
            (last[-1] if last else root).append(part)
            last.append(part[2])
        (last[-1] if last else root).append(["#", "", [], text_hash(text), 1])
        before = path
    return fold(root, True)


def _mark(x: str, y: str, more: bool = False) -> str:
    many = more or bool({x, y} & {"+", "*"})
    none = bool({x, y} & {"?", "*"})
    return "*" if many and none else "+" if many else "?" if none else ""


def _key(part: list) -> object:
    return part[0] if part[0] != "()" else ("()", *[p[0] for p in part[2]])


def _joined(x: list, y: list, more: bool = False, same_page: bool = False) -> list:
    """Two matching parts as one; texts of one page are hashed together, others have to agree."""
    known = x[3] if x[3] == y[3] else None
    if same_page and x[3] is not None and y[3] is not None:
        known = text_hash(x[3], y[3])
    pages = max(x[4], y[4]) if more or same_page else x[4] + y[4]
    parts = align(x[2], y[2], same_page)
    return [x[0], _mark(x[1], y[1], more), parts, known, pages]


def fold(parts: list, same_page: bool = False) -> list:
    """Resolve adjacent repeats, of one part or of several, into repeated groups."""
    out: list = []
    for part in parts:
        part = [part[0], part[1], fold(part[2], same_page), part[3], part[4]]
        if out and _key(out[-1]) == _key(part):
            out[-1] = _joined(out[-1], part, True, same_page)
        else:
            out.append(part)
    keys = [_key(p) for p in out]
    later: dict[object, int] = {}
    after = [0] * len(out)
    for i in range(len(out) - 1, -1, -1):
        after[i] = later.get(keys[i], len(out))
        later[keys[i]] = i
    folded, i = [], 0
    while i < len(out):
        j = after[i]
        size = j - i
        if size > 1 and j + size <= len(out) and keys[i + 1] == keys[j + 1] and keys[i:j] == keys[j : j + size]:
            group, k = out[i:j], j
            while keys[k : k + size] == keys[i:j]:
                group = [_joined(x, y, False, same_page) for x, y in zip(group, out[k : k + size], strict=True)]
                k += size
            folded.append(["()", "+", group, None, 0])
            i = k
        else:
            folded.append(out[i])
            i += 1
    return folded


def _partners(x: list, y: list) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of two lists of keys (Hunt and Szymanski)."""
    places: dict[object, list[int]] = {}
    for j, key in enumerate(y):
        places.setdefault(key, []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, key in enumerate(x):
        for j in reversed(places.get(key, ())):
            at = bisect.bisect_left(ends, j)
            link = (i, j, links[at - 1] if at else None)
            if at == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[at], links[at] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append((link[0], link[1]))
        link = link[2]
    return out[::-1]


def align(x: list, y: list, same_page: bool = False) -> list:
    """Merge two lists of parts along their longest common sequence; the rest is optional."""
    one, two = [_key(p) for p in x], [_key(p) for p in y]
    if one == two:
        return [_joined(a, b, False, same_page) for a, b in zip(x, y, strict=True)]
    out, i, j = [], 0, 0
    for a, b in [*_partners(one, two), (len(x), len(y))]:
        out += [[p[0], _mark(p[1], "?"), *p[2:]] for p in [*x[i:a], *y[j:b]]]
        if a < len(x):
            out.append(_joined(x[a], y[b], False, same_page))
        i, j = a + 1, b + 1
    return fold(out) if len(out) > max(len(x), len(y)) else out


def packed(parts: list) -> tuple[list, list]:
    """(structure, leaves): labels, marks and numbers of parts in order, and (hash, pages)."""
    shape, leaves, todo = [], [], [(len(parts), iter(parts))]
    shape.append(len(parts))
    while todo:
        part = next(todo[-1][1], None)
        if part is None:
            todo.pop()
            continue
        shape += [part[0], part[1], len(part[2])]
        if part[0] == "#":
            leaves.append((part[3], part[4]))
        todo.append((len(part[2]), iter(part[2])))
    return shape, leaves


def unpacked(shape: list, leaves: list) -> list:
    values, known = iter(shape[1:]), iter(leaves)
    root: list = []
    todo = [(shape[0], root)]
    while todo:
        left, into = todo.pop()
        if not left:
            continue
        label, mark, n = next(values), next(values), next(values)
        part = [label, mark, [], *(next(known) if label == "#" else (None, 0))]
        into.append(part)
        todo += [(left - 1, into), (n, part[2])]
    return root


def fields(wrapper: list) -> Iterator[tuple[tuple[str, ...], int | None, int]]:
    """(path, hash or null for a slot, pages) of all fields of a wrapper, groups left out."""
    todo = [((), part) for part in reversed(wrapper)]
    while todo:
        above, (label, _, parts, known, pages) = todo.pop()
        if label == "#":
            yield above, known, pages
        else:
            path = above if label == "()" else (*above, label)
            todo += [(path, part) for part in reversed(parts)]


def is_furniture(path: tuple[str, ...]) -> bool:
    for label in path:
        tag, _, names = label.partition(".")
        if tag in ("html", "body"):
            continue
        if tag in FURNITURE_TAGS or not FURNITURE_WORDS.isdisjoint(_PARTS.split(names)):
            return True
    return False


def content_fields(wrapper: list) -> tuple[set[str], set[str]]:
    """Fields in articles, and fields elsewhere that are no template text, as joined paths."""
    main, rest = set(), set()
    for path, known, pages in fields(wrapper):
        if not is_furniture(path):
            if _MAIN & {label.partition(".")[0] for label in path}:
                main.add("/".join(path))
            elif known is None or pages < AGREE:
                rest.add("/".join(path))
    return main, rest


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


_LEAVES = "array<struct<hash: long, pages: long>>"


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """The wrapper of all wrappers of a group, in an order that no run changes."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
    given = sorted(
        (shape, [(None if x["hash"] is None else int(x["hash"]), int(x["pages"])) for x in leaves])
        for shape, leaves in zip(rows["shape"], rows["leaves"], strict=True)
    ) if len(rows) > 1 else [(rows["shape"].iloc[0], [(x["hash"], x["pages"]) for x in rows["leaves"].iloc[0]])]
    merged = unpacked(json.loads(given[0][0]), given[0][1])
    for shape, leaves in given[1:]:
        merged = align(merged, unpacked(json.loads(shape), leaves))
    shape, leaves = packed(merged)
    made = [{"hash": h, "pages": n} for h, n in leaves]
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "shape": [json.dumps(shape)], "leaves": [made]})


def infer_wrappers(pages: DataFrame, scratch: Scratch, url: str = "url", html: str = "html") -> DataFrame:
    """(host, shape, leaves): the wrapper of each host, packed."""
    wanted = pages.select(_host(F.col(url)).alias("host"), F.col(html).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], list] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shape, leaves = packed(skeleton(list(blocks(page.as_py()))))
                hashes = [h for h, _ in leaves]
                known = found.setdefault((host, json.dumps(shape)), [hashes, 0])
                known[0] = [a if a == b else None for a, b in zip(known[0], hashes, strict=True)]
                known[1] += 1
            hosts, shapes = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hosts, pa.string()), pa.array(shapes, pa.string()),
                    pa.array([v[0] for v in found.values()], pa.list_(pa.int64())),
                    pa.array([v[1] for v in found.values()], pa.int64()),
                ],
                ["host", "shape", "hashes", "pages"],
            )

    seen = scratch.table(
        wanted.mapInArrow(read, "host string, shape string, hashes array<long>, pages long"), "skeletons"
    )
    # Pages of one structure, leaf by leaf; the structure itself travels once.
    kind = F.xxhash64("shape").alias("kind")
    leaf = seen.select("host", kind, "pages", F.posexplode("hashes").alias("at", "h"))
    slot = F.max(F.col("h").isNull()) | (F.min("h") != F.max("h"))
    leaves = leaf.groupBy("host", "kind", "at").agg(
        F.when(~slot, F.min("h")).alias("hash"), F.sum("pages").alias("pages")
    )
    leaves = leaves.groupBy("host", "kind").agg(F.sort_array(F.collect_list(F.struct("at", "hash", "pages"))).alias("l"))
    shapes = seen.groupBy("host", kind).agg(F.first("shape").alias("shape"))
    both = shapes.join(leaves, ["host", "kind"], "left").select(
        "host", "shape", F.coalesce(F.transform("l", lambda x: F.struct(x["hash"], x["pages"])), F.array()).cast(_LEAVES).alias("leaves")
    )
    now, step = scratch.table(both, "wrappers-0"), 0
    while not (many := now.groupBy("host").count().where("count > 1")).isEmpty():
        groups = many.select("host", F.ceil(F.col("count") / FAN).alias("groups"))
        dealt = now.join(groups, "host", "left")
        group = F.pmod(F.xxhash64("shape", F.lit(step)), F.coalesce("groups", F.lit(1)))
        merged = dealt.select("host", "shape", "leaves", group.alias("g")).groupBy("host", "g")
        step += 1
        now = scratch.table(
            merged.applyInPandas(_merge, f"host string, shape string, leaves {_LEAVES}"), f"wrappers-{step}"
        )
    return now


def host_rules(wrappers: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, main, rest): the content fields of each wrapper."""

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for shape, leaves in zip(batch.column(1), batch.column(2), strict=True):
                known = [(x["hash"], x["pages"]) for x in leaves.as_py()]
                found.append(content_fields(unpacked(json.loads(shape.as_py()), known)))
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([sorted(f[k]) for f in found], lists) for k in (0, 1)]],
                ["host", "main", "rest"],
            )

    rules = wrappers.select("host", "shape", "leaves").mapInArrow(
        sort_out, "host string, main array<string>, rest array<string>"
    )
    return scratch.table(rules, "rules")


def main_text(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    scratch = Scratch(pages.sparkSession, "html")
    rules = host_rules(infer_wrappers(pages, scratch, url, html), scratch)
    wanted = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
        _host(F.col(url)).alias("host"),
    )
    length = F.octet_length(F.concat_ws("", "main", "rest")) + 16 * (F.size("main") + F.size("rest")) + 64
    joined = wanted.join(sized(rules, length), "host").select("page_id", "url", "html", "main", "rest")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, main, rest in zip(batch.column("html"), batch.column("main"), batch.column("rest"), strict=True):
                parts = [("/".join(path), text) for path, text in blocks(page.as_py())]
                chosen = set(main.as_py())
                if not any(path in chosen for path, _ in parts):
                    chosen = set(rest.as_py())
                texts.append(" ".join(text for path, text in parts if path in chosen))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
