"""Main text of web pages by landmarks, within wrappers: union-free regular expressions inferred from pages of the same host.

A page is a stream of tags and text slots. The wrapper of a host starts as the
stream of one page and is generalised page by page: neighbouring equal stretches
become a repeated group, and what one side lacks becomes an optional group. It is
inferred from all pages of the host: each page gives its folded stream, and the
distinct ones are generalised in groups of about `FORMS`, whose wrappers are
generalised in turn, until a host has one. Where one would outgrow `ITEMS`, the host
gets a further wrapper, and every stream belongs to one of them, also one that is
longer by itself. A wrapper is compiled to a regular expression over tag symbols with
the main region as a group, and then matched with every page of the streams it stands
for. A page that it doesn't match is read by the same landmarks on its own, so a
wrapper never decides whether a page has a text.

A wrapper only narrows the place: it doesn't choose slots of text by what varies over a host's pages.

The main region is the article (else the main element, else the body). Blocks
of it come in page order; menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out wherever they stand.
Null and empty html give an empty text; repeated pages give repeated rows; a
page without a host belongs to the host ''. A tag that is never closed ends
with its parent.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesight.session import materialise

#: Forms, then wrappers, of a host that are generalised in one group, and the length beyond which a wrapper takes no more.
FORMS = 64
ITEMS = 2048
#: Longest stretch, in tokens, that is looked for as a repeated group.
PERIOD = 12

MAIN = ("article", "main", "body")
#: Symbols are written from this character on, those beyond the last as the last; NONE stands for those that a wrapper lacks.
FIRST, LAST, NONE = 0x10000, 0x10FFFF, "\uffff"
#: Characters of patterns and their symbols that a task remembers compiled.
KNOWN = 20_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|noscript|template|svg|iframe|title)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|</?[a-zA-Z](?:[^\"'<>]|\"[^\"]*\"|'[^']*')*>"
    r"|</?[a-zA-Z][^>]*>"
    r"|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead"
    " tr ul".split())
#: Elements that are never main text.
APART = frozenset("nav aside footer form button select head dialog menu fieldset object".split())
_APART_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|cookies?"
    r"|notices?|consent|gdpr|popup|modal|alert|newsletter|subscribe|share|sharing|social|related|recommended"
    r"|comments?|replies|reply|respond|discussion|disqus|footer|masthead|toolbar|pagination|skip|search|login)(?:$|[\s_-])",
    re.I)
#: An opening tag closes these open elements first.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def apart(name: str, tag: str, in_article: bool) -> bool:
    """Whether an element is no main text, by its name and its class, id and role."""
    if name in APART or name == "header" and not in_article:
        return True
    if name in ("html", "body", "article", "main") or "=" not in tag and "hidden" not in tag:
        return False
    for attribute, a, b, c in _ATTRIBUTE.findall(tag):
        value = a or b or c
        if attribute.lower() == "hidden" and not value or attribute.lower() == "aria-hidden" and value == "true":
            return True
        if _APART_WORD.search(value):
            return True
    return False


def tokens(page: str) -> list[tuple[str, str]]:
    """(symbol, source): the symbol of a tag is its name, with its class if it is a container; of a text, '#'."""
    out = []
    for m in _TOKEN.finditer(page):
        t = m[0]
        if t[0] != "<" or t == "<" or m[1] is None and not _NAME.match(t) and t[1] not in "!?":
            if out and out[-1][0] == "#":
                out[-1] = ("#", out[-1][1] + t)
            elif not t.isspace():
                out.append(("#", t))
            elif out:
                out.append((" ", t))
        elif m[1] is None and t[1] not in "!?":
            name = _NAME.match(t)[1].lower()
            if t[1] == "/":
                out.append(("/" + name, t))
            else:
                kind = next((a or b or c for k, a, b, c in _ATTRIBUTE.findall(t) if k.lower() == "class"), "")
                out.append((f"{name}.{kind}" if kind else name, t))
    return out


def region(stream: list[tuple[str, str]]) -> tuple[int, int]:
    """Where the main region begins and ends: the longest article, else main, else body, else everything."""
    for wanted in MAIN:
        found, depth, begin = [], 0, 0
        for i, (symbol, _) in enumerate(stream):
            name = symbol.partition(".")[0]
            if name == wanted:
                begin, depth = (i if not depth else begin), depth + 1
            elif name == "/" + wanted and depth:
                depth -= 1
                if not depth:
                    found.append((begin, i + 1))
        if depth:
            found.append((begin, len(stream)))
        if found:
            # Comments can be articles too: they are shorter, later or nested.
            return max(found, key=lambda s: sum(len(t) for k, t in stream[s[0] : s[1]] if k == "#"))
    return 0, len(stream)


def blocks(stream: list[tuple[str, str]]) -> str:
    """The text of a region, one line a block."""
    out, current, stack, skipped = [], [], [], 0
    in_article = bool(stream) and stream[0][0].partition(".")[0] == "article"

    def close() -> None:
        if line := " ".join(entities.unescape("".join(current)).split()):
            out.append(line)
        current.clear()

    for symbol, source in stream:
        if symbol in ("#", " "):
            if not skipped:
                current.append(source)
            continue
        name = symbol.partition(".")[0]
        if name[0] == "/":
            name = name[1:]
            if name in BLOCKS:
                close()
            if any(n == name for n, _ in stack):
                while stack:
                    top, hides = stack.pop()
                    skipped -= hides
                    if top == name:
                        break
            continue
        if name in BLOCKS:
            close()
        if name == "br":
            current.append("\n")
        if name in VOID or source.endswith("/>") and name not in BLOCKS:
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in CLOSES.get(name, ()):
                while len(stack) > i:
                    skipped -= stack.pop()[1]
                break
            if stack[i][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "blockquote"):
                break
        hides = int(apart(name, source, in_article))
        stack.append((name, hides))
        skipped += hides
    close()
    return "\n".join(out)


# --- wrappers: an item is a symbol, ("+", items) or ("?", items)


def folded(items: list) -> list:
    """Neighbouring equal stretches as one repeated group, the shortest stretches first."""
    for period in range(1, PERIOD + 1):
        i, out = 0, []
        while i < len(items):
            unit = items[i : i + period]
            k = i + period
            while items[k : k + period] == unit:
                k += period
            if k > i + period and len(unit) == period and any(x not in ("#", " ") for x in unit):
                out.append(("+", tuple(unit)))
                i = k
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def with_groups(items: list, groups: list[tuple]) -> list:
    """Single occurrences of a repeated group of the other side, as that group."""
    for group in groups:
        unit, i, out = list(group[1]), 0, []
        while i < len(items):
            single = items[i : i + len(unit)] == unit
            if not (single or items[i] == group) or not out or out[-1] != group:
                out.append(group if single else items[i])
            i += len(unit) if single else 1
        items = out
    return items


def aligned(wrapper: list, page: list) -> list:
    """The wrapper of both: what they share, and the rest as optional items."""
    optional = {x[1][0] for x in wrapper if x[0] == "?" and isinstance(x, tuple)}
    bare = [x[1][0] if x[0] == "?" and isinstance(x, tuple) else x for x in wrapper]
    groups = lambda items: [x for x in items if isinstance(x, tuple)]
    page, grouped = with_groups(page, groups(bare)), with_groups(bare, groups(page))
    was = [isinstance(x, tuple) and x[0] == "?" for x in wrapper] if grouped == bare else [x in optional for x in grouped]
    out = []
    for same, a, b, c, d in SequenceMatcher(None, grouped, page, autojunk=False).get_opcodes():
        if same == "equal":
            out += [("?", (x,)) if o else x for x, o in zip(grouped[a:b], was[a:b])]
        else:
            out += [("?", (x,)) for x in (*grouped[a:b], *page[c:d])]
    return out


def symbols_of(stream: list[tuple[str, str]]) -> list[str]:
    return [s for s, _ in stream if s != " "]


def merged(wrapper: list, other: list) -> list:
    """The wrapper of what two wrappers stand for."""
    optional = {x[1][0] for x in other if isinstance(x, tuple) and x[0] == "?"}
    bare = [x[1][0] if isinstance(x, tuple) and x[0] == "?" else x for x in other]
    return [("?", (x,)) if x in optional else x for x in aligned(wrapper, bare)]


def generalised(wrappers: list[list], items: int = ITEMS) -> list[tuple[list, list[int]]]:
    """Wrappers that stand for all the given ones, each with the numbers of those it stands for; the last can take more.

    As long as it stays within `items`, a wrapper takes the next one in.
    """
    out: list[tuple[list, list[int]]] = []
    for k, other in enumerate(wrappers):
        if out and max(len(out[-1][0]), len(other)) <= items and len(both := merged(out[-1][0], other)) <= items:
            out[-1] = both, [*out[-1][1], k]
        else:
            out.append((other, [k]))
    return out


def infer(pages: list[list[str]]) -> list:
    """The one wrapper of the symbol streams of some pages; none (no items) if it would outgrow `ITEMS`."""
    found = generalised([folded(page) for page in pages])
    return found[0][0] if len(found) == 1 and len(found[0][0]) <= ITEMS else []


def thawed(x):
    """An item as JSON gives it, with tuples again."""
    return x if isinstance(x, str) else (x[0], tuple(map(thawed, x[1])))


def names_in(item) -> list[str]:
    return [item.partition(".")[0]] if isinstance(item, str) else [n for x in item[1] for n in names_in(x)]


def character(number: int) -> str:
    return chr(min(FIRST + number, LAST))


def compiled(wrapper: list) -> tuple[str, list[str]]:
    """A regular expression with the main region as group 1, one character a symbol; the symbols of the characters.

    Groups never give back what they took: a match costs time in proportion to the page.
    """
    symbols: dict[str, int] = {}

    def expression(x) -> str:
        if isinstance(x, str):
            return character(symbols.setdefault(x, len(symbols)))
        return f"(?:{''.join(map(expression, x[1]))}){x[0]}+"

    found = [names_in(x) for x in wrapper]
    for wanted in MAIN:
        inside = [i for i, names in enumerate(found) if wanted in names]
        if inside:
            end = max([inside[-1], *(i for i, names in enumerate(found) if "/" + wanted in names)])
            parts = wrapper[: inside[0]], wrapper[inside[0] : end + 1], wrapper[end + 1 :]
            break
    else:
        parts = [], wrapper, []
    before, main, after = ("".join(map(expression, p)) for p in parts)
    return f"{before}({main}){after}", [*symbols]


def main_text(page: str | None, wrapper: tuple[re.Pattern, dict[str, str]] | None = None) -> tuple[str, bool]:
    """The main text, and whether the wrapper gave its place."""
    stream = tokens(page or "")
    matched = None
    if wrapper:
        pattern, chars = wrapper
        solid = [i for i, (s, _) in enumerate(stream) if s != " "]
        matched = pattern.fullmatch("".join([chars.get(stream[i][0], NONE) for i in solid]))
    if matched and matched.end(1) > matched.start(1):
        stream = stream[solid[matched.start(1)] : solid[matched.end(1) - 1] + 1]
    begin, end = region(stream)
    return blocks(stream[begin:end]), matched is not None


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def form(page: str) -> str:
    """The folded stream of a page, as JSON."""
    return json.dumps(folded(symbols_of(tokens(page))))


def page_forms(pages: DataFrame) -> DataFrame:
    """host, wrapper: the distinct folded streams of all pages that have any."""
    keyed = pages.select(host("url").alias("host"), "html").where(F.length("html") > 0)

    def run(batches):
        for batch in batches:
            # Equal forms of a batch are sent once.
            rows = {(h, form(page)): None for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())}
            yield pa.record_batch([pa.array([h for h, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.string())],
                                  names=["host", "wrapper"])

    return keyed.mapInArrow(run, "host string, wrapper string").where("wrapper <> '[]'").distinct()


def wrappers(pages: DataFrame, forms: int = FORMS, items: int = ITEMS) -> DataFrame:
    """host, forms, pattern, symbols: the wrappers of each host, from all its pages, with the digests of their forms."""
    def generalise(key, group):
        # The shortest first: the longer ones then add what those lack.
        rows = sorted(zip(group["wrapper"], group["forms"]), key=lambda r: r[0])
        found = sorted((([*map(thawed, json.loads(w))], f) for w, f in rows), key=lambda r: len(r[0]))
        made = generalised([w for w, _ in found], items)
        return pd.DataFrame({
            "host": [key[0]] * len(made), "wrapper": [json.dumps(w) for w, _ in made],
            "forms": [[x for k in members for x in found[k][1]] for _, members in made],
            "full": [k + 1 < len(made) for k in range(len(made))]})

    left = materialise(page_forms(pages).withColumn("forms", F.array(F.md5("wrapper"))), "forms")
    parts = []
    while True:
        n = left.groupBy("host").agg(F.count("*").alias("n"))
        last = (n.agg(F.max("n")).first()[0] or 0) <= forms
        # About `forms` rows in a group.
        dealt = left.join(n, "host").withColumn("_group", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / forms)))
        found = materialise(dealt.groupBy("host", "_group").applyInPandas(
            generalise, "host string, wrapper string, forms array<string>, full boolean"), "generalised")
        parts.append(found if last else found.where("full"))
        if last:
            break
        left = found.where("NOT full").drop("full")

    def compile_all(batches):
        for batch in batches:
            made = [compiled([*map(thawed, json.loads(w))]) for w in batch.column("wrapper").to_pylist()]
            yield pa.record_batch(
                [batch.column("host"), batch.column("forms"), pa.array([p for p, _ in made], pa.string()),
                 pa.array([json.dumps(s) for _, s in made], pa.string())], names=["host", "forms", "pattern", "symbols"])

    rows = reduce(DataFrame.unionByName, parts).select("host", "forms", "wrapper")
    return rows.mapInArrow(compile_all, "host string, forms array<string>, pattern string, symbols string")


def with_form(pages: DataFrame) -> DataFrame:
    """Pages with the digest of their form."""
    def run(batches):
        for batch in batches:
            digests = [hashlib.md5(form(page or "").encode()).hexdigest() for page in batch.column("html").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "form"])

    return pages.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema) + ", form string")


def beside_wrappers(keyed: DataFrame, made: DataFrame) -> DataFrame:
    """Each page with the wrapper of its host; of a host with several, with that of the page's form."""
    several = made.groupBy("host").agg(F.count("*").alias("n")).where("n > 1").select("host")
    cells = ["host", "pattern", "symbols"]
    if several.isEmpty():
        return keyed.join(made.select(cells), "host", "left")
    one = keyed.join(several, "host", "left_anti").join(made.select(cells), "host", "left")
    split = materialise(made.join(several, "host", "left_semi").withColumn("_id", F.monotonically_increasing_id()), "split")
    places = split.select("host", F.explode("forms").alias("form"), "_id")
    found = with_form(keyed.join(several, "host", "left_semi")).join(places, ["host", "form"], "left")
    return one.unionByName(found.join(split.select("_id", "pattern", "symbols"), "_id", "left").drop("_id", "form"))


def extracted(pages: DataFrame, forms: int = FORMS, items: int = ITEMS) -> DataFrame:
    """page_id, url, text, n_chars, by_wrapper: one row per page."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host("url").alias("host"))
    joined = beside_wrappers(keyed, materialise(wrappers(pages, forms, items), "wrappers")).drop("host")

    def run(batches):
        known: dict[tuple[str, str], tuple] = {}
        held = 0
        for batch in batches:
            texts, by = [], []
            for page, pattern, symbols in zip(*(batch.column(c).to_pylist() for c in ("html", "pattern", "symbols"))):
                # Equal patterns can stand for other symbols.
                if pattern is not None and (pattern, symbols) not in known:
                    if held > KNOWN:
                        known.clear()
                        held = 0
                    held += len(pattern) + len(symbols)
                    known[pattern, symbols] = re.compile(pattern), {s: character(i) for i, s in enumerate(json.loads(symbols))}
                text, matched = main_text(page, known.get((pattern, symbols)))
                texts.append(text)
                by.append(matched)
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64()), pa.array(by, pa.bool_())],
                names=["page_id", "url", "text", "n_chars", "by_wrapper"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, by_wrapper boolean")
