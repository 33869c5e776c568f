"""Main text of web pages by template deduction from equivalence classes.

Tokens of a page are its elements, told apart by their path and attributes,
and its runs of text, told apart by path and wording. Tokens of one host that
occur equally often in each of its pages share an occurrence vector and form a
class. A class is valid if it is large and frequent, ordered and nested:

* ordered: its tokens follow each other in one order, in every page and every
  time. Of an unordered class the tokens that keep the order of a reference page
  stay; the others are tried as a class of their own.
* nested: it lies in the same gap between the tokens of another class whenever
  it occurs, or never inside it. Of two classes that are not nested the one with
  fewer tokens goes.

The gaps of the valid classes tell further roles of a token apart: a heading in
one gap is not the same as one in another. Tokens with their roles form classes
again, until no more of them find one. The classes, each in its gap of
another, are the template of the host. What the template leaves open are slots:
the text inside its elements that is not template itself. The main text is that
of the slots inside the article, without those of menus, headers, footers,
sidebars, notices, adverts, forms and comments.

Pages of a host with the same frequent tokens in the same order count as one
with a weight. Vectors are never gathered: a token's vector is the sum of a hash
of (sequence, count) over these, beside the number of pages and of occurrences,
so a hot host is combined before the shuffle.
"""

import html as entities
import json
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F, types as T

from ..operators.storage import settle
from .common import bounded_batches

# A class is frequent if it occurs in so many pages and in such a part of the
# host's pages, and large if it has so many tokens.
LEAST_PAGES, LEAST_PART, LEAST_TOKENS = 8, 0.5, 2
# Template text that makes up more than this part of an article is no template:
# the host's pages are copies.
MOST_REMOVED = 0.3

_RAW = "script|style|noscript|template|iframe|svg|textarea|title|select|math|object|canvas|audio|video"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + _RAW + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var".split())
#: Elements that never hold the article's own text.
ASIDE_TAGS = frozenset("nav header footer aside form head button dialog menu fieldset".split())
#: Words of class, id and role that name such parts of a page.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu menus header masthead footer sidebar sidebars notice notices cookie cookies consent "
    "banner ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments reply replies "
    "respond disqus share sharing social related recommended newsletter subscribe subscription signup login popup "
    "modal overlay breadcrumb breadcrumbs pagination pager widget widgets copyright toolbar search contentinfo "
    "complementary alert form".split())
MAIN_WORDS = frozenset("main articlebody".split())
#: Class words tell nothing about these: they hold the page or the article itself.
NEVER_ASIDE = frozenset("html body main article".split())
READER_WORDS = frozenset("comment comments reply replies".split())
#: Elements that the start of one of the same kind closes.
_CLOSED_BY = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()),
              "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()),
              "td": frozenset("td th".split()), "th": frozenset("td th".split()), "option": frozenset("option".split())}
_BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                          "header hr main nav ol p pre section table ul".split())


class Element:
    """An open or closed element: its token, its parent and whether it is set aside."""

    __slots__ = ("tag", "token", "parent", "aside", "main")

    def __init__(self, tag, token, parent, aside, main):
        self.tag, self.token, self.parent, self.aside, self.main = tag, token, parent, aside, main


def _names(attributes):
    """Sorted words of class, id, role and itemprop."""
    words = set()
    for _, a, b, c in _NAMES.findall(attributes):
        words.update(w.lower() for w in _WORD.findall(a or b or c) if not w.isdigit())
    return words


def parse(page):
    """(elements, runs, order): runs are [element, text, begins a block] in page order.

    ``order`` has the numbers of both as they come in the page, runs as ~number.
    """
    root = Element("", "", None, False, False)
    open_elements, elements, runs, order, fresh = [root], [root], [], [], True
    for match in _TOKEN.finditer(page):
        text = match["text"]
        if text is not None:
            order.append(~len(runs))
            runs.append((open_elements[-1], text, fresh))
            fresh = False
            continue
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in VOID:
            fresh = True
            continue
        if match["close"]:
            if tag in INLINE and open_elements[-1].tag != tag:
                continue
            fresh = fresh or tag not in INLINE
            for at in range(len(open_elements) - 1, 0, -1):
                if open_elements[at].tag == tag:
                    del open_elements[at:]
                    break
            continue
        attributes = match["attributes"]
        names = _names(attributes) if "=" in attributes else set()
        aside = bool(names & ASIDE_WORDS)
        if tag in INLINE:
            # Inline elements count only where they are set aside; they are often left open.
            if aside:
                open_elements.append(Element(tag, "", open_elements[-1], True, False))
            continue
        fresh = True
        while open_elements[-1].tag in INLINE or (open_elements[-1].tag == "p" and tag in _BLOCKS_END_P) or \
                open_elements[-1].tag in _CLOSED_BY.get(tag, ()):
            open_elements.pop()
        parent = open_elements[-1]
        if tag in NEVER_ASIDE:
            # But an article inside an article can be a reader's comment.
            aside = tag == "article" and bool(names & READER_WORDS) and any(e.tag == "article" for e in open_elements)
        own = f"{tag}.{'.'.join(sorted(names))}" if names else tag
        main = tag in ("article", "main") or bool(names & MAIN_WORDS)
        element = Element(tag, f"{parent.token}/{own}", parent, aside or tag in ASIDE_TAGS, main)
        order.append(len(elements))
        elements.append(element)
        if attributes.rstrip().endswith("/") and tag not in _BLOCKS_END_P:
            continue
        open_elements.append(element)
    return elements, runs, order


def _text_token(element, text):
    return f"{element.token}={xxhash.xxh64_hexdigest(' '.join(text.split()))}"


def tokens_of(page, parsed=None):
    """(token, number) of a page as they come: element paths, and texts below their paths."""
    elements, runs, order = parsed or parse(page)
    for at in order:
        if at >= 0:
            yield elements[at].token, at
        elif not runs[~at][1].isspace():
            yield _text_token(*runs[~at][:2]), at


@lru_cache(maxsize=256)
def _places(classes):
    """{role: (class, place, size)} of classes given as JSON, each in its order."""
    return {role: (number, place, len(roles)) for number, roles in enumerate(json.loads(classes))
            for place, role in enumerate(roles)}


def spans(roles, places):
    """(role, place, open, level) of each occurrence; ``open`` are the [class, gap] around it, innermost last.

    A class is open from its first token to its last; ``level`` is where the
    token's own class is open, if it is.
    """
    opened = []
    for role in roles:
        place = places.get(role)
        level = None
        if place is not None and place[1]:
            level = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == place[0]), None)
        yield role, place, opened, level
        if place is None:
            continue
        if not place[1] and place[2] > 1:
            opened.append([place[0], 1])
        elif level is not None:
            if place[1] + 1 == place[2]:
                del opened[level]
            else:
                opened[level][1] = place[1] + 1


def roles_of(sequence, rounds):
    """Roles of a page's frequent tokens: their numbers, and the gap around those that are in no class."""
    roles = own = [str(t) for t in sequence]
    for number, classes in enumerate(rounds):
        roles = [role if place is not None else f"{token}@{number}.{opened[-1][0]}.{opened[-1][1]}" if opened else token
                 for token, (role, place, opened, _) in zip(own, spans(roles, _places(classes)))]
    return roles


def order_of(roles):
    """(broken, order) of a class's roles in a page: one pass of them if it repeats in full, else the whole."""
    size = len(set(roles))
    once = roles[:size]
    broken = len(roles) % size > 0 or roles != once * (len(roles) // size)
    return (True, roles) if broken else (False, once)


def movers(order, reference):
    """Roles that do not keep the order of the reference: those outside a longest increasing run of places."""
    rank = {role: i for i, role in enumerate(reference)}
    seen, values = {}, []
    for role in order:
        values.append(seen.get(role, 0) * len(rank) + rank[role])
        seen[role] = seen.get(role, 0) + 1
    ends, at, before = [], [], []
    for i, value in enumerate(values):
        k = bisect_left(ends, value)
        before.append(at[k - 1] if k else None)
        ends[k:k + 1], at[k:k + 1] = [value], [i]
    keep, i = set(), at[-1]
    while i is not None:
        keep.add(i)
        i = before[i]
    return {role for i, role in enumerate(order) if i not in keep}


def nested(classes, found):
    """The classes that are nested with each other, larger ones first.

    ``found``: (inner, outer, gap, times), with outer -1 for all occurrences of a class.
    """
    times = {inner: n for inner, outer, _, n in found if outer < 0}
    gaps = {}
    for inner, outer, gap, n in found:
        if outer >= 0:
            gaps.setdefault((inner, outer), []).append((gap, n))
    bad = {pair for pair, seen in gaps.items() if len(seen) > 1 or seen[0][1] != times[pair[0]]}
    kept = []
    for number in sorted(range(len(classes)), key=lambda c: (-len(classes[c]), classes[c])):
        if not any((number, k) in bad or (k, number) in bad for k in kept):
            kept.append(number)
    return sorted(classes[k] for k in kept)


def _inside(element, region):
    """Whether an element is in the region or below one of it, with nothing set aside between."""
    while element is not None:
        if id(element) in region:
            return True
        if element.aside:
            return False
        element = element.parent
    return False


@lru_cache(maxsize=64)
def _template(template):
    """(numbers of the frequent tokens, rounds before the last, places in the last) of a template."""
    tokens, rounds = json.loads(template)
    return {t: i for i, t in enumerate(tokens)}, rounds[:-1], _places(rounds[-1])


def _in_template(page, parsed, template):
    """Numbers of a page's elements, and of its runs as ~number, that are in the template."""
    known, rounds, places = _template(template)
    found = [(known[token], at) for token, at in tokens_of(page, parsed) if token in known]
    return {at for role, (_, at) in zip(roles_of([t for t, _ in found], rounds), found) if role in places}


def main_text(page, template=None):
    """Text of the slots of a page's article, given the template of its host."""
    if not page:
        return ""
    parsed = elements, runs, _ = parse(page)
    marks = _in_template(page, parsed, template) if template else set()
    fixed_elements = {id(elements[at]) for at in marks if at >= 0}
    free = {}  # element: whether nothing from it up to the root is set aside

    def is_free(element):
        known = free.get(id(element))
        if known is None:
            known = not element.aside and (element.parent is None or is_free(element.parent))
            free[id(element)] = known
        return known

    # The region: the outermost articles, else the outermost other marked
    # elements, else the elements alike that hold most text.
    marked, holds = {}, {}
    for element, text, _ in runs:
        size = len(text.strip())
        if not size or not is_free(element):
            continue
        up, first = element, True
        while up is not None:
            if up.main:
                marked[id(up)] = up
            if up.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "td", "tr", "pre") and first:
                holds[id(up)] = (holds.get(id(up), (0, up))[0] + size, up)
                first = False
            up = up.parent
    if marked:
        articles = [m for m in marked.values() if m.tag == "article"]
        region = articles or list(marked.values())
    elif holds:
        known = [h for h in holds.values() if id(h[1]) in fixed_elements] or list(holds.values())
        largest = max(known, key=lambda h: h[0])[1]
        region = [h[1] for h in known if h[1].token == largest.token and h[1].parent is largest.parent]
    else:
        return ""
    region = {id(e) for e in region}
    slots = [i for i, (e, _, _) in enumerate(runs) if is_free(e) and _inside(e, region)]
    total = sum(len(runs[i][1]) for i in slots)
    fixed = {i for i in slots if ~i in marks and id(runs[i][0]) in fixed_elements}
    if sum(len(runs[i][1]) for i in fixed) > MOST_REMOVED * total:
        fixed = set()
    taken = set(slots) - fixed
    out, begins = [], True
    for i, (_, text, fresh) in enumerate(runs):
        # What is left out or set aside parts the text around it like a block.
        begins = begins or fresh
        if i in taken:
            out.append((" " if begins else "") + entities.unescape(text))
        begins = i not in taken
    return " ".join("".join(out).split())


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _emit(found, kinds):
    """Rows as an Arrow batch with the columns of a schema."""
    columns = list(zip(*found)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


_TEXT, _LONG, _LIST = pa.string(), pa.int64(), pa.list_(pa.string())


def _count_tokens(batches):
    """(host, token, n_pages) of pages."""
    for batch in batches:
        found = {}
        for host, page in zip(*[c.to_pylist() for c in batch.columns]):
            for token in {t for t, _ in tokens_of(page)}:
                found[host, token] = found.get((host, token), 0) + 1
        yield _emit([(*k, n) for k, n in found.items()], {"host": _TEXT, "token": _TEXT, "n_pages": _LONG})


def _sequences(batches):
    """(host, sequence): numbers of a page's frequent tokens as they come."""
    known, numbers = None, {}
    for batch in batches:
        found = []
        for host, page, tokens in zip(*[c.to_pylist() for c in batch.columns]):
            if tokens != known:
                known, numbers = tokens, {t: i for i, t in enumerate(json.loads(tokens))}
            found.append((host, [numbers[t] for t, _ in tokens_of(page) if t in numbers]))
        yield _emit(found, {"host": _TEXT, "sequence": pa.list_(pa.int32())})


def _pages_of(batch):
    """(host, weight, sequence, roles, classes) of each row of (host, n, sequence, rounds[, classes])."""
    host, n, sequence, rounds, *classes = [c.to_pylist() for c in batch.columns]
    for i in range(batch.num_rows):
        yield host[i], n[i], sequence[i], roles_of(sequence[i], json.loads(rounds[i])), classes[0][i] if classes else None


def _count_roles(batches):
    """(host, role, n_pages, times, low, high): the last two are sums over hashes of (sequence, count)."""
    for batch in batches:
        found = {}
        for host, n, sequence, roles, _ in _pages_of(batch):
            counts = {}
            for role in roles:
                counts[role] = counts.get(role, 0) + 1
            for role, times in counts.items():
                sign = xxhash.xxh64_intdigest(f"{sequence}|{times}")
                known = found.setdefault((host, role), [0, 0, 0, 0])
                for i, more in enumerate((n, n * times, sign & 0x7FFFFFFF, sign >> 33)):
                    known[i] += more
        yield _emit([(*k, *v) for k, v in found.items()], {
            "host": _TEXT, "role": _TEXT, "n_pages": _LONG, "times": _LONG, "low": _LONG, "high": _LONG})


def _orders(batches):
    """(host, class, broken, order): each order in which a class's roles come in a page."""
    for batch in batches:
        found = set()
        for host, _, _, roles, classes in _pages_of(batch):
            places, own = _places(classes), {}
            for role in roles:
                if role in places:
                    own.setdefault(places[role][0], []).append(role)
            for number, order in own.items():
                broken, order = order_of(order)
                found.add((host, number, broken, tuple(order)))
        yield _emit(found, {"host": _TEXT, "class": _LONG, "broken": pa.bool_(), "order": _LIST})


def _moved(batches):
    """(host, class, role): roles that do not keep the order of the reference."""
    for batch in batches:
        found = {(host, number, role) for host, number, order, reference in zip(*[c.to_pylist() for c in batch.columns])
                 for role in movers(order, list(dict.fromkeys(reference)))}
        yield _emit(found, {"host": _TEXT, "class": _LONG, "role": _TEXT})


def _nesting(batches):
    """(host, inner, outer, gap, times) of classes; a class that ends outside the gap it began in has gap 0."""
    for batch in batches:
        found = {}
        for host, n, _, roles, classes in _pages_of(batch):
            for _, place, opened, level in spans(roles, _places(classes)):
                if place is None:
                    continue
                if not place[1]:
                    seen = [(place[0], -1, 0), *((place[0], outer, gap) for outer, gap in opened)]
                else:
                    seen = [(inner, place[0], 0) for inner, _ in opened[level + 1:]] if level is not None else ()
                for key in seen:
                    found[host, *key] = found.get((host, *key), 0) + n
        yield _emit([(*k, n) for k, n in found.items()], {
            "host": _TEXT, "inner": _LONG, "outer": _LONG, "gap": _LONG, "times": _LONG})


def _keep_nested(batches):
    """(host, rounds, size) with the nested classes as one round more, if they hold more roles than the last."""
    for batch in batches:
        out = []
        for host, rounds, size, classes, found in zip(*[c.to_pylist() for c in batch.columns]):
            kept = nested(json.loads(classes), [tuple(f.values()) for f in found])
            now = sum(map(len, kept))
            if now > size:
                out.append((host, json.dumps([*json.loads(rounds), json.dumps(kept)]), now))
        yield _emit(out, {"host": _TEXT, "rounds": _TEXT, "size": _LONG})


def _ordered(orders):
    """(host, roles): ordered classes, from (host, class, broken, order) of all pages."""
    done = None
    while True:
        reference = orders.groupBy("host", "class").agg(F.min(F.struct("broken", "order"))["order"].alias("reference"))
        reference = settle(reference, "references")
        moved = orders.join(reference, ["host", "class"]).where(~F.col("order").eqNullSafe(F.col("reference"))).select(
            "host", "class", "order", "reference").mapInArrow(_moved, "host string, class long, role string")
        moved = settle(moved.groupBy("host", "class").agg(F.collect_set("role").alias("moved")), "moved")
        kept = reference.join(moved, ["host", "class"], "left").select(
            "host", "class", F.array_except(F.array_distinct("reference"), F.coalesce("moved", F.array().cast("array<string>")))
            .alias("roles"), "moved").where(F.size("roles") >= LEAST_TOKENS)
        kept = settle(kept, "ordered")
        done = kept.select("host", "roles") if done is None else done.unionByName(kept.select("host", "roles"))
        # What moved is tried as a class of its own, unless nothing kept its order.
        rest = kept.where(F.size("moved") >= LEAST_TOKENS).select("host", "class", "moved")
        if rest.isEmpty():
            return done
        part = orders.join(rest, ["host", "class"]).select(
            "host", "class", F.filter("order", lambda r: F.array_contains("moved", r)).alias("order"))
        again = part.mapInArrow(_orders_again, "host string, class long, broken boolean, order array<string>")
        orders = settle(again.distinct(), "orders")


def _orders_again(batches):
    for batch in batches:
        found = {(host, number, broken, tuple(order)) for host, number, (broken, order) in (
            (h, c, order_of(o)) for h, c, o in zip(*[c.to_pylist() for c in batch.columns]))}
        yield _emit(found, {"host": _TEXT, "class": _LONG, "broken": pa.bool_(), "order": _LIST})


def templates(pages, page_id="page_id", url="url", html="html"):
    """(host, template): the frequent tokens of each host, and its valid classes of each round, as JSON.

    A token that is in the template of a host occurs in half of its pages or
    more, so the list is no longer than twice the tokens of a usual page.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    sizes = settle(rows.groupBy("host").count(), "host_pages")
    frequent = lambda counted: counted.where(F.col("n_pages") >= LEAST_PAGES).join(sizes, "host").where(
        F.col("n_pages") >= LEAST_PART * F.col("count")).drop("count")
    tokens = frequent(rows.mapInArrow(_count_tokens, "host string, token string, n_pages long")
                      .groupBy("host", "token").agg(F.sum("n_pages").alias("n_pages")))
    tokens = settle(tokens.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list("token"))).alias("tokens")),
                    "frequent_tokens")
    sequences = rows.join(tokens, "host").mapInArrow(_sequences, "host string, sequence array<int>")
    sequences = settle(sequences.groupBy("host", "sequence").agg(F.count(F.lit(1)).alias("n")), "sequences")
    rounds = tokens.select("host", F.lit("[]").alias("rounds"), F.lit(0).cast("long").alias("size"))
    found = None  # of every round, the hosts whose classes grew
    while True:
        seen = sequences.join(rounds, "host").select("host", "n", "sequence", "rounds")
        roles = frequent(seen.mapInArrow(_count_roles, "host string, role string, n_pages long, times long, low long, high long")
                         .groupBy("host", "role").agg(*[F.sum(c).alias(c) for c in ("n_pages", "times", "low", "high")]))
        alike = roles.groupBy("host", "n_pages", "times", "low", "high").agg(
            F.sort_array(F.collect_list("role")).alias("roles")).where(F.size("roles") >= LEAST_TOKENS)
        listed = lambda classes, name: settle(classes.groupBy("host").agg(
            F.to_json(F.sort_array(F.collect_list("roles"))).alias("classes")), name)
        classes = listed(alike, "classes")
        met = lambda classes: seen.join(classes, "host").select("host", "n", "sequence", "rounds", "classes")
        orders = met(classes).mapInArrow(_orders, "host string, class long, broken boolean, order array<string>")
        classes = listed(_ordered(settle(orders.distinct(), "orders")), "ordered_classes")
        nesting = met(classes).mapInArrow(_nesting, "host string, inner long, outer long, gap long, times long")
        nesting = nesting.groupBy("host", "inner", "outer", "gap").agg(F.sum("times").alias("times"))
        nesting = nesting.groupBy("host").agg(F.collect_list(F.struct("inner", "outer", "gap", "times")).alias("found"))
        grown = rounds.join(classes, "host").join(nesting, "host").select("host", "rounds", "size", "classes", "found")
        rounds = settle(grown.mapInArrow(_keep_nested, "host string, rounds string, size long"), "rounds")
        found = rounds if found is None else found.unionByName(rounds)
        if rounds.isEmpty():
            break
    last = found.groupBy("host").agg(F.max_by("rounds", "size").alias("rounds"))
    return last.join(tokens, "host").select(
        "host", F.concat(F.lit("["), "tokens", F.lit(", "), "rounds", F.lit("]")).alias("template"))


def extract(pages, page_id="page_id", url="url", html="html"):
    """(page_id, url, text, n_chars) of every page.

    A null or empty page, and one without an article, gives the empty text and
    0. Pages of hosts with few pages have no template; their slots are all the
    text of the article. Repeated rows stay; a null url is the host ''.
    """
    spark = bounded_batches(pages.sparkSession)
    found = settle(templates(pages, page_id, url, html), "templates")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        host_of(F.col(url)).alias("host"))
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "template")
    bounded_batches(spark)

    def run(batches):
        for batch in batches:
            texts = [main_text(page, template)
                     for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, T.StructType([
        joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType())]))
