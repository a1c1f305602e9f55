"""Main text of web pages by wrappers: one union-free regular expression per host, inferred from the host's pages."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, tiered_join

SALTS = 64
MAX_DEPTH = 60
TEMPLATE_PAGES = 8
SHARE_BELOW = 0.6

TAG = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*+>")
NAME = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

# Elements by how they are shown, and names that sites give to what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
OUTSIDE = frozenset("head nav header footer aside form button select dialog menu".split())
NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|"
    r"pagination|pager|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|tags?|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story)(?:$|[\s_-])", re.I)


def parse(page: str) -> list:
    """The page as a tree of blocks: [key, children]; a child is a block or a string of text.

    Character references are decoded, inline elements are part of the text around them, and what is never shown is
    left out. Unclosed and stray tags are put right as browsers do for blocks. Blocks deeper than 60 join their parent.
    """
    root = ["", []]
    stack, deep, at, held = [("", root)], 0, 0, []

    def text(begin, end):
        if end > begin:
            held.append(entities.unescape(page[begin:end]))

    def settle():
        if held:
            words = " ".join("".join(held).split())
            held.clear()
            if words:
                stack[-1][1][1].append(words)

    def close(names, stop=()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                settle()
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    while True:
        found = TAG.search(page, at)
        if not found:
            text(at, len(page))
            break
        text(at, found.start())
        at = found.end()
        if found[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        shut, name, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            continue
        if name == "br":
            held.append(" ")
            continue
        if shut:
            if name not in VOID and name not in RAW:
                if deep and name not in {n for n, _ in stack}:
                    deep -= 1
                close({name})
            continue
        if name in RAW:
            if not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = len(page) if end is None else end.end()
            continue
        if name in CLOSES_P:
            close({"p"}, ("table", "td", "li", "div", "section", "article"))
        if name in CLOSED_BY:
            close(CLOSED_BY[name], ("table", "ul", "ol", "dl", "select", "menu") if name != "tbody" else ("table",))
        settle()
        if name in VOID:
            continue
        if len(stack) > MAX_DEPTH:
            deep += 1
            continue
        marks = " ".join(m[2].strip("\"'") for m in NAME.finditer(rest)) if rest else ""
        block = [f"{name} {re.sub('[0-9]+', '0', marks)}".strip(), []]
        stack[-1][1][1].append(block)
        stack.append((name, block))
    settle()
    return root


# ---- wrappers: key, optional, repeated, children; a text slot has the key "#" and what was seen in it ----


def _slot(words: str) -> dict:
    mark = hashlib.blake2b(words.encode(), digest_size=6).hexdigest()
    return {"k": "#", "o": 0, "r": 0, "n": 1, "lo": mark, "hi": mark, "m": len(words)}


def wrapper_of(block: list) -> dict:
    """A page as a wrapper. Neighbours of one form become a repeated group, also where text stands between them."""
    node = {"k": block[0], "o": 0, "r": 0, "n": 1, "c": []}
    for child in block[1]:
        new = _slot(child) if isinstance(child, str) else wrapper_of(child)
        for back in (1, 2):
            if len(node["c"]) >= back and node["c"][-back]["k"] == new["k"]:
                if back == 2 and new["k"] == "#":
                    continue
                same = merge(node["c"][-back], new)
                same["r"], same["n"] = 1, 1
                node["c"][-back] = same
                if back == 2:
                    node["c"][-1]["o"] = 1
                break
        else:
            node["c"].append(new)
    return node


def page_wrapper(page: list) -> dict:
    """``wrapper_of`` with a mark of the page's longest text, which tells different articles from copies."""
    longest, todo = "", [page]
    while todo:
        for child in todo.pop()[1]:
            if not isinstance(child, str):
                if not boilerplate(child[0]):
                    todo.append(child)
            elif len(child) > len(longest):
                longest = child
    return wrapper_of(page) | {"d": [_slot(longest)["lo"]]}


def merge(a: dict, b: dict) -> dict:
    """Align two wrappers of one key. What only one has becomes optional, repeated stays repeated."""
    out = {"k": a["k"], "o": a["o"] | b["o"], "r": a["r"] | b["r"], "n": a["n"] + b["n"]}
    if "d" in a:  # marks of different articles, as many as are asked for
        out["d"] = sorted({*a["d"], *b["d"]})[:TEMPLATE_PAGES]
    if a["k"] == "#":
        return out | {"lo": min(a["lo"], b["lo"]), "hi": max(a["hi"], b["hi"]), "m": a["m"] + b["m"]}
    x, y = a["c"], b["c"]
    if [i["k"] for i in x] == [i["k"] for i in y]:
        return out | {"c": [merge(i, j) for i, j in zip(x, y)]}
    # Longest common subsequence of the keys.
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i]["k"] == y[j]["k"] else max(best[i + 1][j], best[i][j + 1])
    children, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i]["k"] == y[j]["k"]:
            children.append(merge(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            children.append(x[i] | {"o": 1})
            i += 1
        else:
            children.append(y[j] | {"o": 1})
            j += 1
    return out | {"c": _fold(children)}


def _fold(children: list[dict]) -> list[dict]:
    """Optional neighbours of one key, which alignment put side by side, are one repeated group."""
    out = []
    for child in children:
        if out and out[-1]["k"] == child["k"]:
            pages = max(out[-1]["n"], child["n"])
            out[-1] = merge(out[-1], child) | {"r": 1, "n": pages, "o": out[-1]["o"] & child["o"]}
        else:
            out.append(child)
    return out


def expression(node: dict) -> str:
    """The wrapper as a regular expression over tags and #text."""
    body = "#text" if node["k"] == "#" else f"<{node['k']}>{''.join(map(expression, node['c']))}</>" if node["k"] else "".join(map(expression, node["c"]))
    mark = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[node["o"], node["r"]]
    return f"({body}){mark}" if mark else body


def chars(node: dict) -> int:
    return node["m"] if node["k"] == "#" else 0 if boilerplate(node["k"]) else sum(map(chars, node["c"]))


def boilerplate(key: str) -> bool:
    name, _, marks = key.partition(" ")
    return name in OUTSIDE or bool(marks and NOT_ARTICLE.search(marks))


def article_paths(wrapper: dict) -> list[tuple[str, ...]]:
    """Where the host's articles are: its article or main elements, else blocks so named, else where most text is."""
    for test in (lambda k: k.partition(" ")[0] == "article", lambda k: k.partition(" ")[0] == "main", lambda k: bool(ARTICLE.search(k.partition(" ")[2]))):
        found = []

        def walk(node, path):
            for child in node["c"]:
                if child["k"] == "#" or boilerplate(child["k"]):
                    continue
                if test(child["k"]) and chars(child):  # noqa: B023
                    found.append((*path, child["k"]))  # noqa: B023
                else:
                    walk(child, (*path, child["k"]))

        walk(wrapper, ())
        if found:
            return sorted(set(found))
    path, node = (), wrapper
    while True:
        heavy = max((c for c in node["c"] if c["k"] != "#"), key=chars, default=None)
        if heavy is None or not chars(node) or chars(heavy) < SHARE_BELOW * chars(node) or heavy["r"]:
            return [path]
        path, node = (*path, heavy["k"]), heavy


def aligned(block: list, node: dict | None) -> list[dict | None]:
    """For every child of the page's block, the wrapper's child that it is a case of, in the order of both.

    Neighbours of one form are one group as in ``wrapper_of``, and a wrapper's child takes one group. As many groups as
    possible have one, and of the wrapper's children those that are not optional come first.
    """
    keys, place = [], []
    for child in block[1]:
        key = "#" if isinstance(child, str) else child[0]
        for back in (1, 2):
            if len(keys) >= back and keys[-back] == key and (back == 1 or key != "#"):
                place.append(len(keys) - back)
                break
        else:
            place.append(len(keys))
            keys.append(key)
    known = node["c"] if node else []
    if keys == [c["k"] for c in known]:
        return [known[i] for i in place]
    best = [[0] * (len(known) + 1) for _ in range(len(keys) + 1)]
    for i in range(len(keys) - 1, -1, -1):
        for j in range(len(known) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1])
            if keys[i] == known[j]["k"]:
                best[i][j] = max(best[i][j], best[i + 1][j + 1] + 2 - known[j]["o"])
    chosen, i, j = [None] * len(keys), 0, 0
    while i < len(keys) and j < len(known):
        if keys[i] == known[j]["k"] and best[i][j] == best[i + 1][j + 1] + 2 - known[j]["o"]:
            chosen[i] = known[j]
            i, j = i + 1, j + 1
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            i += 1
    return [chosen[i] for i in place]


def extract(page: list, wrapper: dict, paths: list[tuple[str, ...]]) -> str:
    """The page's article, read along the wrapper: the text of its slots in page order.

    ``paths`` are the wrapper's ``article_paths``. A slot that holds the same words on all pages of a host with at least
    8 different articles is part of the template: neither it nor a block around it is optional. A page that has neither
    text nor blocks does not count.
    """
    parts: list[str] = []
    varied = len(wrapper.get("d", ())) >= TEMPLATE_PAGES

    def read(block, node, always):
        for child, case in zip(block[1], aligned(block, node)):
            if isinstance(child, str):
                fixed = always and case and not case["o"] and not case["r"] and case["n"] >= wrapper["n"]
                fixed = fixed and case["lo"] == case["hi"] == _slot(child)["lo"]
                if not fixed:
                    parts.append(child)
            elif not boilerplate(child[0]):
                read(child, case, bool(always and case and not case["o"]))

    def enter(block, node, paths, always):
        if () in paths:
            read(block, node, always)
            return
        for child, case in zip(block[1], aligned(block, node)):
            rest = [] if isinstance(child, str) else [p[1:] for p in paths if p[0] == child[0]]
            if rest:
                enter(child, case, rest, bool(always and case and not case["o"]))

    enter(page, wrapper, paths, varied)
    return " ".join(parts)


def host_of(url):
    """The part of the url between // and the next /, ?, # or :; lower case; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def joined(a: dict, b: dict) -> dict:
    """``merge`` of two wrappers of a host; empty pages make nothing optional."""
    return merge(a, b) if a["c"] and b["c"] else a if a["c"] else b


def _infer(batches):
    """Fold the pages of a task into one wrapper per host."""
    found: dict[str, tuple[dict, int]] = {}
    for batch in slices(batches):
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            new = page_wrapper(parse(page or ""))
            old = found.get(host)
            found[host] = (joined(old[0], new), old[1] + 1) if old else (new, 1)
    salt = TaskContext.get().partitionId() % SALTS
    yield pa.RecordBatch.from_pydict(
        {"host": pa.array(list(found), pa.string()), "salt": pa.array([salt] * len(found), pa.int32()), "wrapper": pa.array([json.dumps(w) for w, _ in found.values()], pa.string()), "pages": pa.array([n for _, n in found.values()], pa.int64())}
    )


def _join(frame: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(frame["wrapper"])
    whole = json.loads(rows[0])
    for row in rows[1:]:
        whole = joined(whole, json.loads(row))
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "salt": [0], "wrapper": [json.dumps(whole)], "pages": [frame["pages"].sum()]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host``, ``wrapper`` (JSON), ``pages``: from every page of every host. Written.

    A task folds its pages host by host, so a host with a third of all pages sends one wrapper per task. Those are
    merged in 64 salts first and then per host.
    """
    schema = "host string, salt int, wrapper string, pages bigint"
    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_infer, schema)
    salted = parts.groupBy("host", "salt").applyInPandas(_join, schema)
    return materialize(salted.groupBy("host").applyInPandas(_join, schema).drop("salt"))


def _read(batches):
    cache: dict[str, tuple] = {}
    for batch in slices(batches):
        if len(cache) > 100:
            cache.clear()
        texts = []
        for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
            if wrapper not in cache:
                whole = json.loads(wrapper)
                cache[wrapper] = whole, article_paths(whole)
            tree = parse(page or "")
            text = extract(tree, *cache[wrapper])
            if not text:  # its article is elsewhere than on the host's other pages: the page is its own wrapper
                own = wrapper_of(tree)
                text = extract(tree, own, article_paths(own))
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page.

    Blocks are trimmed, their white space is one space, and they are joined by one space in page order. Null and empty
    pages, and pages without an article, have an empty text. Pages with a null url, or one without a host, share the
    empty host. Words that are the same on all pages of a host are left out if at least 8 of its articles differ; a host
    with fewer keeps them, and so does one with a page that has them not. Other columns are ignored; repeated rows are returned each. Wrappers of hot hosts are broadcast, the
    others join by host.
    """
    wrappers = infer_wrappers(pages)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = tiered_join(rows, wrappers, ["host"], "pages").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(_read, "page_id bigint, url string, text string, n_chars bigint")


def op8_main_text(spark, folder):
    return main_text(spark.read.parquet(f"{folder}/pages.parquet"))
