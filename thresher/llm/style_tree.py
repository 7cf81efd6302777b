"""Main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are paths of tags with their
presentation (class, id, role). A node has two distributions over the host's pages: of the
sequences of children it shows (presentation) and of the texts it holds (content). Its
importance is the greater of the two entropies, each divided by the logarithm of the number of
times the node occurs: a menu or notice repeated on every page has 0, an article 1. Branches
below IMPORTANCE are removed from every page of the host.

Entropy cannot tell an advert that changes from page to page, so nodes whose tag or
presentation names a role (menu, footer, advert, form, comments and so on) are removed
whatever their entropy, and so are lists, tables and paragraphs that are mostly links. The tree
decides inside an article or main element too; only the element itself is never removed, and
neither are marked words of a sentence. Around such an element, text is kept where the tree has found
importance; where it has seen too few pages to tell, the element alone is the main text. Copies of a
page count as one page. A page of which the tree would leave nothing is read without it.

Counts are totalled per host, node and value before any row of a host meets another, so
a large host is no large group; per host only the list of removed nodes is joined to its
pages. Null, empty and broken html, and urls without a host, give the text found, or an
empty one. Repeated pages are separate rows. A very long page is read whole, its text in one piece; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import xxhash
from pyspark.sql import DataFrame, functions as F

from thresher.llm.registry import query, table
from thresher.llm.texts import arrow, batch, slices
from thresher.operators.ordering import HOT_SHARE, join_small
from thresher.session import pinned

IMPORTANCE = 0.1
LEAST_PAGES = 2
# Pages of a hot host that are cleaned with one copy of its lists.
PAGES_PER_TASK = 2_000
LINK_SHARE = 0.6
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Elements by kind, and the words that name a role.
SKIPPED = frozenset("script style noscript template svg iframe object textarea select title".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
MAIN = frozenset("article main".split())
NOISE_TAGS = frozenset("nav header footer aside form button menu dialog head".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form "
    "header menu modal nav navbar navigation newsletter notice notices popup promo related respond share sharing sidebar social sponsor "
    "sponsored subscribe teaser toolbar widget complementary contentinfo navigation search".split())
# Elements that a new one of the same kind closes.
CLOSED_BY = {"p": INLINE | {"p"}, "li": INLINE | {"li", "p"}, "td": INLINE | {"td", "th", "p"}, "tr": INLINE | {"tr", "td", "th", "p"},
             "dt": INLINE | {"dt", "dd", "p"}, "dd": INLINE | {"dt", "dd", "p"}, "option": {"option"}}
NODES = "host string, node long, kind int, value long, around int, share double"


class Node:
    """An element: its tag, presentation, children (nodes and strings) and path."""

    __slots__ = ("tag", "style", "children", "path", "noise", "main")

    def __init__(self, tag, attributes, parent):
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        self.tag, self.children = tag, []
        self.style = " ".join(f"{k}={found[k]}" for k in ("class", "id", "role") if k in found)
        named = re.split(r"[^a-z0-9]+", " ".join(found.get(k, "") for k in ("class", "id", "role")).lower())
        self.noise = tag in NOISE_TAGS or not NOISE_WORDS.isdisjoint(named)
        self.main = tag in MAIN or found.get("role", "").lower() in MAIN
        self.path = f"{parent.path}/{tag}[{self.style}]" if parent else ""


def parsed(source):
    """The tree of a page; whatever is not closed ends with its parent."""
    root = Node("", "", None)
    stack, at, size = [root], 0, len(source)
    while at < size:
        found = TOKEN.search(source, at)
        if not found:
            stack[-1].children.append(source[at:])
            break
        if found.start() > at:
            stack[-1].children.append(source[at:found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            open_tags = [n.tag for n in stack]
            if tag in open_tags[1:]:
                del stack[len(open_tags) - 1 - open_tags[::-1].index(tag):]
            continue
        if tag in CLOSED_BY:
            # Only elements the new one may close lie above the one it closes.
            above = len(stack)
            while above > 1 and stack[above - 1].tag in CLOSED_BY[tag]:
                above -= 1
            closes = [i for i in range(above, len(stack)) if stack[i].tag in CLOSED_BY and stack[i].tag in CLOSED_BY[tag]]
            if closes:
                del stack[closes[0]:]
        node = Node(tag, found[3], stack[-1])
        if tag in SKIPPED:
            end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else size
            continue
        stack[-1].children.append(node)
        if tag not in EMPTY and not (found[3] or "").rstrip().endswith("/"):
            stack.append(node)
    return root


def text_of(node):
    """All text below a node, blocks apart."""
    out, todo = [], [node]
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            out.append(one)
            continue
        apart = one.tag not in INLINE
        todo += ([" "] if apart else []) + one.children[::-1] + ([" "] if apart else [])
    return "".join(out)


def hashed(text):
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def branches(root):
    """The article and main elements of a page, without those inside others or inside noise."""
    found, todo = [], [root]
    while todo:
        one = todo.pop()
        if one.main and not one.noise:
            found.append(one)
        elif not one.noise:
            todo += [c for c in one.children[::-1] if not isinstance(c, str)]
    return found


def nodes_of(root):
    """(node, presentation, content) hashes of the elements of a page that hold text.

    The last value tells elements around an article or main element: neither in one nor above it.
    """
    found = branches(root)
    above = [one.path + "/" for one in found]
    todo = [(root, not found)]
    while todo:
        one, inside = todo.pop()
        inside = inside or one in found
        below = [c for c in one.children if not isinstance(c, str)]
        todo += [(c, inside) for c in below]
        if one is not root:
            shape, text = ",".join(f"{c.tag}[{c.style}]" for c in below), " ".join(text_of(one).split())
            if text:
                around = not inside and not any(path.startswith(one.path + "/") for path in above)
                yield hashed(one.path), hashed(shape), hashed(text), int(around)


def link_share(node):
    """The share of a block's text that stands in links."""
    todo, linked, total = [(node, False)], 0, 0
    while todo:
        one, inside = todo.pop()
        if isinstance(one, str):
            size = len(one.strip())
            total += size
            linked += size if inside else 0
        else:
            todo += [(c, inside or one.tag == "a") for c in one.children]
    return linked / total if total else 0.0


def in_sentence(node, parent):
    """Whether an element marks words of a text that goes on around it."""
    return node.tag in INLINE and any(isinstance(c, str) and c.strip() for c in parent.children)


def main_text(source, removed, important=frozenset()):
    """The text of a page without noise.

    `removed` holds the nodes its host's tree condemns, `important` those around articles that it does not.
    """
    root = parsed(source)
    text = text_without(root, removed, important)
    return text if text or not removed else text_without(root, frozenset(), important)


def text_without(root, removed, important):
    found = branches(root)
    # Each element with its parent and where it stands: around the main branch, inside it, or in a text of its own.
    around, inside, own = range(3)
    out, todo = [], [(root, None, around if found else own)]
    while todo:
        one, parent, place = todo.pop()
        if isinstance(one, str):
            if place != around:
                out.append(one)
            continue
        if one in found:
            place = inside
        elif one.noise:
            out.append(" ")
            continue
        elif one is not root:
            node = hashed(one.path)
            if place == around and node in important and link_share(one) <= LINK_SHARE:
                place = own
            gone = place != around and node in removed and not (place == inside and in_sentence(one, parent))
            if gone or place == own and one.tag in ("ul", "ol", "dl", "table", "p") and link_share(one) > LINK_SHARE:
                out.append(" ")
                continue
        apart = [(" ", None, own)] if one.tag not in INLINE else []
        todo += apart + [(c, one, place) for c in one.children[::-1]] + apart
    return " ".join(entities.unescape("".join(out)).split())


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def condemned(pages: DataFrame, importance=IMPORTANCE, least_pages=LEAST_PAGES) -> DataFrame:
    """(host, removed, important): per host the nodes of low importance, and those around articles that are not."""

    def run(batches):
        schema = arrow(NODES)
        for one in slices(batches, 200):
            rows = []
            for host, source, share in zip(*(one.column(c).to_pylist() for c in range(3))):
                for node, shape, content, around in set(nodes_of(parsed(source or ""))):
                    rows += [(host, node, 0, shape, around, share), (host, node, 1, content, around, share)]
            yield batch(schema, *(zip(*rows) if rows else [[]] * len(schema)))

    # Copies of a page tell no more than one of them.
    page = F.xxhash64("html")
    copies = pages.groupBy("host", page.alias("page")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").withColumn("part", 1 / F.col("copies"))
    weighed = join_small(pages.select("host", "html", page.alias("page")), copies, ["host", "page"], "copies", "left").select(
        "host", "html", F.coalesce("part", F.lit(1.0)).alias("share"))
    nodes = weighed.mapInArrow(run, NODES)
    counts = nodes.groupBy("host", "node", "kind", "value").agg(F.round(F.sum("share")).alias("n"), F.max("around").alias("around"))
    spread = counts.groupBy("host", "node", "kind").agg(F.max("around").alias("around"), F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("told"))
    entropy = (F.log("pages") - F.col("told") / F.col("pages")) / F.log("pages")
    least = spread.filter(F.col("pages") >= least_pages).groupBy("host", "node").agg(F.max(entropy).alias("importance"), F.max("around").alias("around"))
    low = F.col("importance") < importance
    return least.filter(low | (F.col("around") == 1)).groupBy("host").agg(
        F.collect_set(F.when(low, F.col("node"))).alias("removed"), F.collect_set(F.when(~low, F.col("node"))).alias("important"))


def extracted(pages: DataFrame, importance=IMPORTANCE, least_pages=LEAST_PAGES) -> DataFrame:
    """page_id, url and the main text of every page."""
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    lists = pinned(condemned(pages, importance, least_pages))
    # A host with very many pages is dealt out over several tasks, with its lists for each of them.
    hosts = pinned(pages.groupBy(F.col("host").alias("hot")).agg(F.count(F.lit(1)).alias("n")))
    hosts = F.broadcast(hosts.filter(F.col("n") * HOT_SHARE >= hosts.agg(F.sum("n")).scalar()).select(  # HOT_SHARE rows at most
        "hot", F.ceil(F.col("n") / PAGES_PER_TASK).cast("int").alias("tasks")))
    shared = lambda rows: rows.join(hosts, F.col("host") == F.col("hot"), "left")
    tasks = F.coalesce("tasks", F.lit(1))
    dealt = shared(pages).withColumn("task", F.pmod(F.xxhash64("page_id", "url"), tasks).cast("int"))
    lists = shared(lists).select(F.col("host").alias("of"), "removed", "important", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("for_task"))
    joined = dealt.join(lists, (F.col("host") == F.col("of")) & (F.col("task") == F.col("for_task")), "left").select("page_id", "url", "html", "removed", "important")

    def run(batches):
        schema = arrow("page_id long, url string, text string, n_chars long")
        for one in slices(batches, 200):
            texts = [main_text(h or "", frozenset(r or ()), frozenset(i or ())) for h, r, i in zip(*(one.column(c).to_pylist() for c in (2, 3, 4)))]
            yield batch(schema, one.column(0), one.column(1).cast("string"), texts, [len(t) for t in texts])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query()
def op4_style_tree(spark, sf_dir):
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))
