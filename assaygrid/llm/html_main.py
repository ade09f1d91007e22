"""Main text of web pages: subtrees that recur over a host's pages go, as do parts that say they are not the article."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.common import column
from assaygrid.session import cut

# Element names of the HTML standard, and words that name a part's role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr caption figcaption summary".split())
ITEMS = frozenset("li dt dd td th option".split())
DROPPED = frozenset("""script style noscript template svg math iframe object embed audio video canvas map nav header footer aside form button
select textarea input label fieldset dialog menu head title datalist frame frameset noembed noframes xmp""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
PARTS = frozenset("""ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies
consent gdpr notice notices popup modal overlay newsletter subscribe subscription paywall nav navbar navigation menu breadcrumb breadcrumbs sidebar
rail footer header masthead comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations
widget widgets toolbar pagination pager pagenav login signup signin search skip skiplink""".split())
# A block of so many words is prose, also in a list; a container with so many words of prose may be a story.
LONG, MANY = 12, 30
# Kinds of subtrees, strictest bound first: what may be article prose, a container with much prose, one with little.
PROSE_LIKE, FULL, LIGHT = 0, 1, 2
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
# Part names that prose goes by as well.
DOUBTFUL = frozenset("search social promotion related rail notice notices alert respond reply share sharing widget widgets banner menu recommended sponsored".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WANTED, MAYBE, OPENING, UNWANTED = range(4)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z]+")
# What a start tag ends: the open elements it closes, and those beyond which it does not look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BOUND = frozenset("html body article main section div table td th blockquote aside nav header footer form ul ol".split())


def unwanted(tag: str, attrs: str) -> int:
    """Does an element say that it is no part of the article? MAYBE where only a doubtful or a compound name says so, or it is a form."""
    out = OPENING if tag == "header" else MAYBE if tag == "form" else UNWANTED if tag in DROPPED else WANTED
    if not attrs or tag in ("html", "body", "main"):
        return out
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id"):
            for one in value.split():
                parts = [x for x in SPLIT.split(one) if x]
                named = [x for x in parts if x in (COMMENTS if tag == "article" else PARTS)]
                if named:
                    clear = any(x not in DOUBTFUL for x in named) or tag not in BLOCK
                    out = max(out, UNWANTED if clear else MAYBE)
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return UNWANTED
        if name == "style" and "display:none" in value.replace(" ", ""):
            return UNWANTED
    return out


def parse(html: str | None):
    """(blocks, tree, whole): blocks are (text, place in the tree or -1, in an unwanted part?), in page order.

    The tree lists the subtrees that may be templates, as (hash, place of the next one around it or -1, kind). All blocks come back, those of
    unwanted parts too, so that their subtrees are counted. A subtree's hash covers its tags, the text right in it with white space made single, and its
    children's hashes, so hashing is linear in the page. Inside an article, paragraphs, headings, list items and cells are content and
    are not in the tree; only what contains them may be a template. Containers outside articles are LIGHT or FULL by their
    words of prose, everything else is PROSE_LIKE. A form, or a part with a doubtful name, is unwanted unless it holds MANY words in blocks of
    LONG words; a header inside an article keeps its headings. `whole` hashes the wanted text, only that of article and main elements if
    this is most of it.
    """
    from html import unescape

    import xxhash

    html = html or ""
    # Open elements: [tag, state, inside an article?, node, text set aside, undecided node or -1]. Inline elements that are wanted are not
    # kept: their text is their block's. An unwanted one sets the text before it aside and drops its own at its end.
    # Nodes: [parent, hasher, hash, droppable?, container outside articles?, words of prose, words in long blocks, undecided node around].
    nodes: list[list] = []
    stack: list[list] = []
    found: list[tuple] = []
    text: list[str] = []
    opened: dict[str, int] = {}

    def flush():
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                many = words.count(" ") + 1
                top = stack[-1] if stack else None
                if top:
                    node = nodes[top[3]]
                    node[1].update("\0" + words)
                    node[5] += many if many >= LONG or not any(x[0] in ITEMS for x in stack[-2:]) else 0
                    node[6] += many if many >= LONG and top[1] < OPENING else 0
                found.append((words, top[3] if top else -1, bool(top and top[2]), bool(top and top[1] >= OPENING), top[5] if top else -1))

    def push(tag, attrs):
        up = stack[-1] if stack else ["", WANTED, False, -1, None, -1]
        root = tag in ("article", "main")
        inside = up[2] or root
        state = unwanted(tag, attrs)
        if up[1] == UNWANTED or up[1] == OPENING and not (tag in HEADINGS and up[2] and state == WANTED):
            state = max(state, up[1])
        aside = None
        if tag not in BLOCK:
            if state < OPENING:
                return
            if up[1] < OPENING:
                aside = text[:]
                text.clear()
        droppable = not root and tag not in ("html", "body") and not (inside and tag in PROSE)
        k = len(nodes)
        nodes.append([up[3], xxhash.xxh3_64("<" + tag), 0, droppable, not inside and tag not in PROSE, 0, 0, up[5]])
        stack.append([tag, state, inside, k, aside, k if state == MAYBE else up[5]])
        opened[tag] = opened.get(tag, 0) + 1

    def pop():
        tag, _, _, k, aside, _ = stack[-1]
        if tag in BLOCK:
            flush()
        elif aside is not None:
            text[:] = aside
        stack.pop()
        opened[tag] -= 1
        node = nodes[k]
        node[2] = node[1].intdigest() - (1 << 63)
        if stack:
            around = nodes[stack[-1][3]]
            around[1].update(node[1].digest())
            around[5] += node[5]
            around[6] += node[6]
        node[1] = None

    def end(tags, bounds=()):
        if not any(opened.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in bounds:
                return

    at = 0
    while True:
        m = TOKEN.search(html, at)
        if m is None:
            text.append(unescape(html[at:]))
            break
        if m.start() > at:
            text.append(unescape(html[at:m.start()]))
        at = m.end()
        name = m["name"]
        if not name:
            continue
        tag = name.lower()
        if m["end"]:
            if tag in BLOCK:
                flush()
            end({tag}, () if tag in BLOCK else BOUND)
            continue
        if tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            if tag in ("article", "main"):
                while any(opened.get(t) for t in ("nav", "header", "footer", "aside", "form", "p")):
                    pop()
            end({"p"}, BOUND)
            if tag in ENDS:
                end(*ENDS[tag])
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}\\s*/?>", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        push(tag, m["attrs"])
    flush()
    while stack:
        pop()
    # Parents stand before their children, so one pass settles what an undecided part around a part says, and where each
    # subtree hangs in the tree of those that may be templates.
    gone, place, tree = [], [], []
    for parent, _, digest, droppable, outside, prose, long, around in nodes:
        gone.append(around >= 0 and (gone[around] or nodes[around][6] < MANY))
        over = place[parent] if parent >= 0 else -1
        if droppable:
            tree.append((digest, over, (LIGHT if prose < MANY else FULL) if outside else PROSE_LIKE))
            over = len(tree) - 1
        place.append(over)
    blocks = [(words, place[k] if k >= 0 else -1, inside, part or around >= 0 and (gone[around] or nodes[around][6] < MANY)) for words, k, inside, part, around in found]
    inner, outer = (sum(len(x[0]) for x in blocks if x[2] is side and not x[3]) for side in (True, False))
    whole = xxhash.xxh3_64()
    for words, _, inside, part in blocks:
        if not part and (inside or inner <= outer):
            whole.update(words + "\n")
    return [(words, k, part) for words, k, _, part in blocks], tree, whole.intdigest() - (1 << 63)


def without_templates(blocks, parents, hashes, gone):
    """The blocks of a page, [(text, place, part)], that lie in no subtree whose hash is in `gone`."""
    lost: list[bool] = []
    for digest, parent in zip(hashes, parents):
        lost.append(digest in gone or parent >= 0 and lost[parent])
    return [b for b in blocks if b[1] < 0 or not lost[b[1]]]


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, host, blocks, tree, whole)."""
    def run(batches):
        import pyarrow as pa

        subtree = pa.list_(pa.struct([("hash", pa.int64()), ("parent", pa.int32()), ("kind", pa.int32())]))
        kind = pa.list_(pa.struct([("text", pa.string()), ("place", pa.int32()), ("part", pa.bool_())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                done = [parse(h.as_py()) for h in some.column(2)]
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array([[{"text": t, "place": k, "part": p} for t, k, p in b] for b, _, _ in done], kind),
                    pa.array([[{"hash": h, "parent": p, "kind": n} for h, p, n in t] for _, t, _ in done], subtree), pa.array([w for _, _, w in done], pa.int64())],
                    ["page_id", "url", "blocks", "tree", "whole"])

    own = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).alias("url"), column(pages, html_col).alias("html"))
    out = own.mapInArrow(run, "page_id long, url string, blocks array<struct<text:string,place:int,part:boolean>>, tree array<struct<hash:long,parent:int,kind:int>>, whole long")
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return out.withColumn("host", F.when(host != "", host))


def templates(seen: DataFrame, bounds) -> DataFrame:
    """(host, hashes): subtrees that stand on at least so many pages, and on such a share of the pages, of a host.

    `bounds` has (pages, share) by the kind of the subtree. Pages of one host with the same text count once, so copies
    of an article do not make it a template. At most (subtrees a page) / (least share) hashes of a host can pass, which
    bounds the array.
    """
    own = seen.where("host is not null")
    pages = own.groupBy("host", "whole").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    hashes = own.select("host", "whole", F.inline("tree"))
    n = hashes.groupBy("host", "hash", "whole").agg(F.min("kind").alias("kind")).groupBy("host", "hash").agg(
        F.count("*").alias("n"), F.min("kind").alias("kind"))
    pick = lambda i: F.element_at(F.array(*[F.lit(float(b[i])) for b in bounds]), F.col("kind") + 1)
    often = n.where(F.col("n") >= pick(0)).join(pages, "host")
    return often.where(F.col("n") >= pick(1) * F.col("pages")).groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              least: int = 10, share: float = 0.5, full=(100, 0.01), light=(3, 0.01)) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_removed.

    A subtree is a template on at least `least` pages and the share `share` of its host. A container outside articles
    is one too by the (pages, share) of `light`, if it holds little prose, or of `full`; these are low enough for
    one section of a host and for hosts of few pages. Pages are parsed once, whole, and kept as blocks with the hashes of the subtrees around them;
    the hashes are counted by host, unwanted parts included, and a page loses the n_removed blocks
    inside a subtree that recurs. What is left of the parts that name their role goes after that; all else
    stays, inside an article element or not. Null or
    empty html gives the empty text; pages without a host lose no template; broken or cut markup is
    read as far as it goes. Character references are decoded, white space inside a block becomes one
    space, blocks are joined by two line feeds. Repeated ids are pages of their own. No rows, no result.
    """
    seen = cut(parsed(pages, id_col, url_col, html_col), "page-blocks")
    bounds = [(least, share), *((min(least, n), min(share, part)) for n, part in (full, light))]
    found = cut(templates(seen, bounds), "page-templates").withColumnRenamed("host", "of")
    joined = seen.join(found, F.col("host") == F.col("of"), "left")
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, removed = [], []
            for blocks, tree, gone in zip(*(batch.column(c) for c in ("blocks", "tree", "hashes"))):
                blocks = [(b["text"], b["place"], b["part"]) for b in blocks.as_py()]
                gone = set(gone.as_py() or ())
                left = without_templates(blocks, *([t[c] for t in tree.as_py()] for c in ("parent", "hash")), gone) if gone else blocks
                texts.append("\n\n".join(t for t, _, part in left if not part))
                removed.append(len(blocks) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())],
                                             ["page_id", "url", "text", "n_removed"])

    done = joined.select("page_id", "url", "blocks", "tree", "hashes").mapInArrow(run, "page_id long, url string, text string, n_removed long")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")
