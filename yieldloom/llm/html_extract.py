"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: a node stands for all elements with the same chain of
tags, classes and ids. For each node the tree holds how many pages have it, which presentations (markup
inside it) they use, and which contents: the whole text as runs of ``RUN`` words or so, each word in one of them. A run
ends with the text or with a word whose hash says so, so the same content has the same runs wherever it stands. What k pages have in common
counts 1/k, which is m^(H-1) for its entropy H = 1 - log k / log m among the node's m pages: the share of the node's
content that is its own. So menus, notices and footers that stay the same make a node unimportant, and so do adverts
and links that rotate, as soon as there are more pages than adverts. Presentations count by their entropy. Nodes of the same
chain on all hosts make up a tree of their own, so that small hosts have evidence, too, and content that is the same
from site to site is found. Evidence needs ``LEAST_PAGES`` pages of the host, or as many hosts.

A node is removed from every page of the host where its importance, times a prior, is low in either tree. Article and
main elements raise the prior; elements that name another purpose (menus, headers, footers, sidebars, notices, adverts)
lower it, so that varied content of varied shape outweighs a name. A class names a purpose if its last telling word does:
social-science, banner-title and widget-review name none. Where there is no evidence, names decide. Forms, what
isn't shown, and readers' comments are never content. A name alone never empties a page without article and main
elements; and if nothing is left of a page, the text of its article and main elements stays, as a site may repeat an article.

The tree's counts are summed within tasks before they are shuffled, so a host may have any share of the
pages; only the removed and the named nodes of a host, not its pages, are gathered.

Cases: null html is empty and gives an empty text; pages without markup are one block; unclosed elements
end where HTML ends them; repeated rows count as further pages; a null url is a host of its own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.llm.common import materialize, slices, texts

LEAST_PAGES = 8
CONTENT_WEIGHT = 0.8
LEAST_IMPORTANCE = 0.25
#: Priors by part (PLAIN, KEPT, REMOVED, GONE): evidence against a node of an article must be twice as strong; a name is
#: outweighed by an importance above 0.83, which takes varied shapes besides texts of its own; GONE always goes.
PRIORS = (1.0, 2.0, 0.3, 0.0)
#: Words of a run, on average.
RUN = 8
#: The removed nodes of all hosts are broadcast up to this size; beyond it hosts are dealt into parts.
BROADCAST_BYTES = 8 << 20
PARTS = 64

#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea template noscript iframe select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
NEVER = frozenset("form head title button label fieldset".split())
#: Elements that end an open element of the key's kind when they begin.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role attributes that name a purpose other than content.
PURPOSES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promos promotion "
    "sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer footers "
    "foot bottombar topbar header masthead cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login search searchbox share sharing social related recommended "
    "widget widgets toolbar skip complementary contentinfo".split()
)
#: Words that name readers' comments.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Words after a purpose that don't name another one (ad-slot, menu-item).
FILLERS = frozenset(
    "area bar block body bottom box button buttons card col column container content count desktop element form frame grid group holder "
    "icon icons image img inner item items large left link links list mobile module outer panel right row section slot small space strip "
    "text top unit wrap wrapper zone".split()
)
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Words after which a name in the same class tells of another element (has-sidebar), and
#: words that begin classes of a post's keywords (tag-advertising).
OTHERS = frozenset("has with without no not".split())
TAXONOMY = frozenset("tag category cat".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PLAIN, KEPT, REMOVED, GONE = range(4)


class _Open:
    __slots__ = ("tag", "path", "part", "branch", "children")

    def __init__(self, tag: str, path: str, part: int, branch: int = 0):
        self.tag, self.path, self.part, self.branch = tag, path, part, branch
        self.children: list[str] = []


def _purpose(name: str) -> int:
    """PLAIN, REMOVED or GONE by a class, id or role: what its last telling word names, if no word such as *has* leads to it."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[0] in TAXONOMY:
        return PLAIN
    while len(words) > 1 and words[-1] in FILLERS:
        words.pop()
    if len(words) > 1 and words[-2] in OTHERS:
        return PLAIN
    return GONE if words[-1] in COMMENTS else REMOVED if words[-1] in PURPOSES else PLAIN


def _label(tag: str, attributes: str) -> tuple[str, int]:
    """The node's name in the style tree, and the part that its attributes name."""
    if "=" not in attributes:
        return tag, PLAIN
    names, purpose = [], PLAIN
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        purpose = max(purpose, *map(_purpose, value.split())) if value.strip() else purpose
        names += [re.sub(r"\d+", "", value)] * len(value.split())
    return ".".join([tag, *names]), purpose


def blocks(page: str, by_name: bool = True) -> tuple[list[tuple[str, int, str]], dict[str, list[str]]]:
    """(path, part, text) of each block in page order, and the child labels of each path. On a page without
    an article or main element the branch with most text that only its class or id takes out is let in: what
    holds the text isn't an advert, whatever it is called. Without ``by_name`` no name makes a part REMOVED."""
    found, shapes, named, marked = _read(page, by_name)
    if not marked and named and all(part >= REMOVED for _, part, _ in found):
        sizes: Counter = Counter()
        for (_, _, text), branch in zip(found, named, strict=True):
            if branch:
                sizes[branch] += len(text)
        if sizes:
            best = max(sizes, key=lambda k: (sizes[k], -k))
            found = [(path, PLAIN if branch == best else part, text) for (path, part, text), branch in zip(found, named, strict=True)]
    return found, shapes


def _read(page: str, by_name: bool = True) -> tuple[list[tuple[str, int, str]], dict[str, list[str]], list[int], bool]:
    """As :func:`blocks`, before any branch is let in; for each block the number of the branch whose class or
    id takes it out (0 if none, or if a tag does); and whether there is an article or main element."""
    named: list[int] = []
    marked = False
    branches = 0
    out: list[tuple[str, int, str]] = []
    stack = [_Open("", "", PLAIN)]
    shapes: dict[str, list[str]] = {}
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                k = len(stack) - 1
                while k and stack[k].tag not in BLOCKS:
                    k -= 1
                out.append((stack[k].path, max(stack[-1].part, stack[k].part), text))
                named.append(stack[-1].branch)

    def close(k: int) -> None:
        for x in stack[k:]:
            if x.children:
                shapes.setdefault(x.path, []).append(",".join(dict.fromkeys(x.children)))
        del stack[k:]

    at = look = 0
    while (sign := page.find("<", look)) >= 0:
        m = _TAG.match(page, sign)
        if not m:
            look = sign + 1
            continue
        if sign > at:
            held.append(page[at:sign])
        at = look = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in BLOCKS:
                        flush()
                    close(k)
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in BLOCKS:
            flush()
            ends = SIBLINGS.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag == "br":
            held.append(" ")
        if tag in VOID:
            stack[-1].children.append(tag)
            continue
        if tag in RAW:
            if attributes.endswith("/"):
                continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = look = end.end() if end else len(page)
            held.append(" ")
            continue
        label, purpose = _label(tag, attributes)
        up = stack[-1]
        up.children.append(label)
        part, branch = up.part, up.branch
        marked |= tag in ("article", "main")
        if part >= REMOVED and tag in BOILERPLATE | NEVER:
            branch = 0
        if part < REMOVED or tag == "main":  # a page has one main element, which no menu or advert holds
            if tag == "main":
                part = KEPT
            elif by_name and (tag in BOILERPLATE or (tag == "header" and part != KEPT)):
                part = REMOVED
            elif by_name and purpose and tag not in ("html", "body"):
                part, branch = purpose, branches + 1
                branches = branch
            elif tag == "article":
                part = KEPT
        if tag in NEVER or (purpose == GONE and tag not in ("html", "body", "main")):
            part = GONE
        stack.append(_Open(tag, f"{up.path}>{label}", part, branch))
    held.append(page[at:])
    flush()
    close(1)
    return out, shapes, named, marked


def main_text(page: str, noise: frozenset[str] = frozenset(), content: frozenset[str] = frozenset(), by_name: bool = True) -> str:
    """Blocks outside the paths ``noise``, and of named parts those of the paths ``content``; if there are none, all of
    article and main elements."""
    found, _ = blocks(page, by_name)
    kept = [text for path, part, text in found if (path in content if part == REMOVED else part != GONE and path not in noise)]
    return "\n".join(kept or [text for _, part, text in found if part == KEPT])


def _runs(texts: list[str]) -> list[int]:
    """All that a node's content on a page consists of, as hashes."""
    runs = set()
    for text in texts:
        words, start = text.split(), 0
        for k, word in enumerate(words, 1):
            if k == len(words) or xxhash.xxh3_64_intdigest(word) % RUN == 0:
                runs.add(" ".join(words[start:k]))
                start = k
    return [xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in runs]


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _counted(pages: DataFrame, by_name: bool) -> DataFrame:
    """host, path, kind (0 part, 1 content, 2 presentation), feature, k (pages of the host's node that have it)."""
    schema = "host string, path string, kind int, feature long, n long"

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for host, page in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found, shapes = blocks(page, by_name)
                rows, parts, contents = [], {}, {}
                for path, part, text in found:
                    if part != GONE:
                        parts[path] = max(part, parts.get(path, 0))
                        contents.setdefault(path, []).append(text)
                for path, part in parts.items():
                    rows.append((host, path, 0, part))
                    rows.append((host, path, 2, xxhash.xxh3_64_intdigest(";".join(shapes.get(path, ()))) - (1 << 63)))
                    rows += [(host, path, 1, run) for run in _runs(contents[path])]
                counts.update(rows)
            columns = list(zip(*counts, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(list(counts.values()), pa.int64())], ["host", "path", "kind", "feature", "n"])

    rows = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(run, schema)
    return rows.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("k"))


def _nodes(counted: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, part, pages, importance (0 to 1, without the prior) of the nodes of a tree."""
    k = F.col("k").cast("double")

    def total(kind: int, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value).otherwise(0.0))

    nodes = counted.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("feature"))).cast("int").alias("part"), total(0, k).alias("m"), total(1, k).alias("c"), total(1, F.lit(1.0)).alias("c_own"), total(2, k).alias("p"), total(2, k * F.log(k)).alias("p_log")
    )
    log_m = F.log("m")
    presentation = (log_m - F.col("p_log") / F.col("p")) / log_m
    # 0 if all pages have the same, 1 if each has its own
    content = F.greatest(F.lit(0.0), (F.col("c_own") / F.col("c") * F.col("m") - 1) / (F.col("m") - 1))
    importance = F.when(F.col("m") > 1, CONTENT_WEIGHT * content + (1 - CONTENT_WEIGHT) * presentation).otherwise(F.lit(1.0))
    return nodes.select(*keys, "part", F.col("m").cast("long").alias("pages"), importance.alias("importance"))


def style_tree(pages: DataFrame, by_name: bool = True) -> DataFrame:
    """host, path, part, pages (that have the node), importance (0 to 1, without the prior) for each node
    with text, and all_hosts and all_importance of the same chain on all hosts."""
    counted = materialize(_counted(pages, by_name))
    everywhere = counted.groupBy("path", "kind", "feature").agg(F.sum("k").alias("k"))
    everywhere = _nodes(everywhere, ["path"]).select(F.col("path").alias("of_path"), F.col("importance").alias("all_importance"))
    own = materialize(_nodes(counted, ["host", "path"]))
    hosts = own.groupBy(F.col("path").alias("on_path")).agg(F.count(F.lit(1)).alias("all_hosts"))
    joined = own.join(everywhere, F.col("path") == F.col("of_path")).join(hosts, F.col("path") == F.col("on_path"))
    return joined.drop("of_path", "on_path")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, by_name: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html). Without ``by_name`` evidence decides alone."""
    prior = F.element_at(F.array(*[F.lit(p) for p in PRIORS]), F.col("part") + 1)

    def low(n: str, importance: str) -> Column:
        return (F.col(n) >= least_pages) & (F.col(importance) * prior < least_importance)

    unimportant = low("pages", "importance") | low("all_hosts", "all_importance")
    known = F.greatest("pages", "all_hosts") >= least_pages
    named = F.col("part") == REMOVED
    # of parts that are removed by their names without evidence, those that stay are gathered
    judged = style_tree(pages, by_name).select("host", F.when(~named & unimportant, F.col("path")).alias("noise"), F.when(named & known & ~unimportant, F.col("path")).alias("content"))
    judged = judged.where("noise is not null or content is not null").groupBy(F.col("host").alias("of_host")).agg(F.collect_list("noise").alias("noise"), F.collect_list("content").alias("content"))
    noise = materialize(judged)
    rows = pages.select("page_id", "url", "html").withColumn("host", _host(F.col("url")))
    held = noise.agg(F.sum(F.aggregate(F.concat("noise", "content"), F.lit(0), lambda n, p: n + F.octet_length(p)) + 64)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(noise), F.col("host") == F.col("of_host"), "left")
    else:  # a host may have any share of the pages: deal them out with a copy of its noise for each part
        noise = noise.withColumn("of_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        part = F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int")
        rows = rows.withColumn("part", part).join(noise, (F.col("host") == F.col("of_host")) & (F.col("part") == F.col("of_part")), "left")
    rows = rows.select("page_id", "url", "html", "noise", "content")
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html", 8 << 20):
                out = [main_text(page, frozenset(n or ()), frozenset(c or ()), by_name) for page, n, c in zip(texts(batch.column("html")), batch.column("noise").to_pylist(), batch.column("content").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
