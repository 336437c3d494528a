"""Variant spellings of names typed by people (problem 5).

A name is read into a head (surname, or root of an organisation) and the rest (given name and initials, or field and
kind). Heads are linked by MinHash banding over padded q-grams, the names behind linked heads by Monge-Elkan similarity
of their words, and the links are clustered into stars.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkir.operators.orphans import NODE_KEY, normal_key
from sparkir.operators.skew import hot_keys, salted_join
from sparkir.session import cut

# Short forms of given names, in English use.
NICKNAMES = dict(
    pair.split("=") for pair in (
        "alex=alexander sasha=alexander andy=andrew annie=anna tony=anthony becky=rebecca ben=benjamin bill=william will=william "
        "bob=robert rob=robert cathy=catherine chris=christopher kit=christopher dan=daniel dave=david mitya=dmitri dima=dmitri "
        "thea=dorothea dot=dorothea ed=edward liz=elizabeth beth=elizabeth betty=elizabeth fran=frances gabe=gabriel greg=gregory "
        "etta=henrietta hetty=henrietta iggy=ignatius jim=james jon=jonathan joe=joseph josie=josephine kate=katherine kathy=katherine "
        "leo=leonard len=leonard peggy=margaret maggie=margaret matt=matthew mike=michael mick=michael nick=nicholas tavi=octavia "
        "pip=philippa pat=patricia pete=peter quin=quentin dick=richard rick=richard sam=samuel steve=stephen ted=theodore theo=theodore "
        "tom=thomas ulla=ursula vicky=victoria vic=victoria mina=wilhelmina willa=wilhelmina yoli=yolanda zack=zachary"
    ).split()
)
# Kinds of organisations and their short forms.
KINDS = dict(
    pair.split("=") for pair in (
        "laboratory=laboratory laboratories=laboratory lab=laboratory institute=institute inst=institute group=group grp=group "
        "university=university univ=university association=association assoc=association company=company co=company "
        "foundation=foundation fdn=foundation college=college coll=college society=society soc=society department=department dept=department "
        "centre=centre center=centre ctr=centre corporation=corporation corp=corporation school=school academy=academy agency=agency council=council"
    ).split()
)
TITLES = {"dr", "prof", "mr", "mrs", "ms", "sir"}
LEGAL = {"ltd", "inc", "llc", "plc", "gmbh", "limited"}


def folded(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return " ".join(s.casefold().split())


def read_name(raw: str) -> tuple[str, str, str, str, str]:
    """(shape, head, given, middle, kind) of a typed name.

    shape is person, org or short (a head with letters behind it, which may be either). given is a given name or an
    initial, for an organisation its field; middle holds further initials; for a short form given is the first letter
    and middle the rest.
    """
    s = folded(raw)
    upper_tail = re.search(r"\s([^\W\d_]{2,3})\s*$", raw)
    s = re.sub(r"^(?:%s)\.\s+" % "|".join(sorted(TITLES)), "", s)
    s = re.sub(r"^the\s+(?=\S+[\s-]\S)", "", s)
    s = re.sub(r"[\s,]+(?:%s)\.?$" % "|".join(sorted(LEGAL)), "", s)
    before, comma, after = s.partition(",")
    words = re.findall(r"[^\W_]+", s)
    if not words:
        return ("none", "", "", "", "")
    if comma and (m := re.fullmatch(r"\s*(\w+) of (\w+(?: \w+)*)\s*", before)) and m[1] in KINDS:
        return ("org", " ".join(re.findall(r"[^\W_]+", after)), m[2], "", KINDS[m[1]])
    at = [i for i, w in enumerate(words) if w in KINDS]
    if not comma and at and len(words) >= 2:
        i = at[-1]
        kind = KINDS[words[i]]
        if i == len(words) - 1:
            if i >= 2:
                return ("org", " ".join(words[: i - 1]), words[i - 1], "", kind)
            return ("org", words[0], "", "", kind)
        if i >= 1:
            return ("org", " ".join(words[i + 1 :]), words[i - 1], "", kind)
    if comma:
        rest = re.findall(r"[^\W_]+", after)
        head = " ".join(re.findall(r"[^\W_]+", before))
        if not rest or not head:
            return ("person", head or " ".join(rest), "", "", "")
        return ("person", head, rest[0], "".join(w[0] for w in rest[1:]), "")
    if len(words) >= 2 and len(words[-1]) in (2, 3) and upper_tail and "." not in s and len(words[-2]) > 3:
        t = upper_tail[1]
        if t.isupper() or t.islower():
            return ("short", " ".join(words[:-1]), words[-1][0], words[-1][1:], "")
    if len(words) == 1:
        return ("person", words[0], "", "", "")
    return ("person", words[-1], words[0], "".join(w[0] for w in words[1:-1]), "")


@lru_cache(1 << 16)
def edits(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between a and b; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def closeness(a: str, b: str) -> float:
    """1 for equal words, less by 1 / length for each edit."""
    return 1 - edits(a, b) / max(len(a), len(b), 1)


@lru_cache(1 << 14)
def full_forms(given: str) -> frozenset[str]:
    """The given name, and the full forms of the nicknames that it is or is one typo from."""
    near = {NICKNAMES[given]} if given in NICKNAMES else {NICKNAMES[n] for n in NICKNAMES if len(given) > 3 and n[0] == given[0] and edits(given, n) == 1 and len(n) > 3}
    return frozenset({given} | near) if given not in NICKNAMES else frozenset(near)


def word_match(a: str, b: str) -> float:
    """Closeness of two inner words; an initial or the beginning of a word (three letters or more) matches it fully."""
    if not a or not b:
        return 1.0
    x, y = sorted((a, b), key=len)
    if len(x) == 1 or (3 <= len(x) <= 5 and len(y) - len(x) >= 2 and y.startswith(x)):
        return float(x[0] == y[0])
    return max(closeness(p, q) for p in full_forms(a) for q in full_forms(b))


def monge_elkan(a: tuple, b: tuple) -> float:
    """Mean of the best matches of the words of two read names; 0 where a word that both have does not match.

    Words with a role are only held against words of the same role, so the best match of each is known.
    """
    (sa, ha, ga, ma, ka), (sb, hb, gb, mb, kb) = a, b
    head = closeness(ha, hb)
    if "short" in (sa, sb) and sa != sb and "org" in (sa, sb):
        short, org = (a, b) if sa == "short" else (b, a)
        ok = bool(org[2]) and short[2] == org[2][0] and short[3] == org[4][:1]
        return (head + 2 * ok) / 3 if ok else 0.0
    if ("org" in (sa, sb)) and sa != sb:
        return 0.0
    if sa == "org":
        parts = [head, word_match(ga, gb), float(ka == kb)]
    else:
        n = min(len(ma), len(mb))
        parts = [head, word_match(ga, gb), float(ma[:n] == mb[:n])]
    return 0.0 if min(parts) < 0.6 else sum(parts) / len(parts)


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The least number of bands of ``rows`` values at which pairs of this q-gram similarity collide with ``recall``:
    1 - (1 - similarity ** rows) ** bands."""
    return ceil(log(1 - recall) / log(1 - similarity**rows))


def head_bands(heads: pd.Series, q: int, rows: int, bands: int, seed: int = 7) -> np.ndarray:
    """One 64-bit key per head and band of the MinHash of its padded q-grams."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 1 << 63, rows * bands, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)
    out = np.empty((len(heads), bands), np.int64)
    for i, h in enumerate(heads):
        p = "\x02" * (q - 1) + h + "\x03" * (q - 1)
        grams = pd.util.hash_array(np.array(list({p[j : j + q] for j in range(len(p) - q + 1)}), dtype=object))
        with np.errstate(over="ignore"):
            v = grams[:, None] * mul[None, :] + add[None, :]
            v ^= v >> np.uint64(29)
            least = (v * np.uint64(0xBF58476D1CE4E5B9)).min(0).reshape(bands, rows)
            key = least[:, 0].copy()
            for r in range(1, rows):
                key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + least[:, r]
        out[i] = key.view(np.int64)
    return out


def typed_names(documents: DataFrame) -> DataFrame:
    """(name, uses): the different strings of metadata.entities, relations.source and relations.target that are not node
    keys, null or blank, with the number of their occurrences."""
    m = documents.select("metadata.entities", "metadata.relations")
    none = F.array().cast("array<string>")
    rel = F.filter(F.coalesce("relations", F.array().cast("array<struct<relation:string,source:string,target:string>>")), lambda r: r.isNotNull())
    every = F.concat(F.coalesce("entities", none), F.transform(rel, lambda r: r["source"]), F.transform(rel, lambda r: r["target"]))
    v = m.select(F.explode(every).alias("name")).filter("name IS NOT NULL")
    return v.filter(~normal_key("name").rlike(NODE_KEY) & (normal_key("name") != "")).groupBy("name").agg(F.count("*").alias("uses"))


READ = "shape string, head string, given string, middle string, kind string"


def agrees(a: tuple, b: tuple) -> bool:
    """Whether the words beside the heads of two read names leave no doubt: both have some, and none differs."""
    return bool(a[2] and b[2]) and min(len(a[1]), len(b[1])) >= 8 and word_match(a[2], b[2]) >= 0.7


#: Typos of a word make up at most about this share of its and their mass.
TYPO_SHARE = 0.16


def least_share(mine: Column, other: Column, z: float) -> Column:
    """Wilson's lower bound, at z standard deviations, of the share of ``mine`` in mine + other.

    The bound nears the share as the masses grow, so masses of any size answer alike, only the surer the greater they are."""
    n = mine + other
    p = mine / n
    half = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z
    return F.when(n > 0, (p + z * z / (2 * n) - half) / (1 + z * z / n)).otherwise(0.0)


def close_words(words: DataFrame, q: int, rows: int, bands: int, most: int) -> DataFrame:
    """(head, head_b, mass, mass_b, apart, typo, unsure), in both directions: the pairs of ``words`` (head, spelled, used) that share
    a band and are at most ``most`` edits apart. However often a word is spelled, it is compared.

    mass is the number of spellings and that of uses, scaled to spellings by the collection's mean uses of a spelling. typo:
    the other has more mass, and by spellings or uses the word's share of both is one of typos, to one standard deviation;
    unsure: it is, or two standard deviations leave it open. Words of like mass are neither, they are two words.
    """

    def band(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            keys = head_bands(p["head"], q, rows, bands)
            yield pd.DataFrame({"head": np.repeat(p["head"].to_numpy(), bands), "band": np.tile(np.arange(bands, dtype=np.int32), len(p)), "key": keys.ravel()})

    def distances(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(apart=np.array([edits(x, y, max(3, most)) for x, y in zip(p["head"], p["head_b"])], dtype=np.int32))

    banded = cut(words.select("head").mapInPandas(band, "head string, band int, key long"))
    other = banded.select(F.col("head").alias("head_b"), "band", "key")
    maybe = (F.col("head") < F.col("head_b")) & (F.abs(F.length("head") - F.length("head_b")) <= most)
    pairs = banded.join(other, ["band", "key"]).filter(maybe).select("head", "head_b").distinct()
    # a swap of neighbours is two edits to levenshtein
    pairs = pairs.filter(F.levenshtein("head", "head_b") <= 2 * most)
    pairs = cut(pairs.mapInPandas(distances, "head string, head_b string, apart int").filter(F.col("apart") <= most))
    pairs = pairs.unionByName(pairs.select(F.col("head_b").alias("head"), F.col("head").alias("head_b"), "apart"))
    every = words.agg(F.sum("spelled").alias("s"), F.sum("used").alias("u")).first()
    weighed = words.select("head", "spelled", (F.col("used") * F.lit((every.s or 0) / max(1, every.u or 0))).alias("scaled")).withColumn("mass", F.col("spelled") + F.col("scaled"))
    other = weighed.select(*[F.col(c).alias(f"{c}_b") for c in weighed.columns])
    out = pairs.join(weighed, "head").join(other, "head_b")
    more = F.struct("mass", "head") < F.struct("mass_b", "head_b")
    share = {z: F.least(*[least_share(F.col(c).cast("double"), F.col(f"{c}_b").cast("double"), z) for c in ("spelled", "scaled")]) for z in (1, 2)}
    return cut(out.select("head", "head_b", "mass", "mass_b", "apart", (more & (share[1] <= TYPO_SHARE)).alias("typo"), (more & (share[2] <= TYPO_SHARE)).alias("unsure")))


def typo_roots(close: DataFrame) -> DataFrame:
    """(head, root) of the words that are typos, from ``close_words``: the neighbour of most mass of which they are, followed
    to a word that is no typo itself. The mass grows on the way, so it ends."""
    roots = cut(close.filter("typo").groupBy("head").agg(F.max(F.struct("mass_b", "head_b"))["head_b"].alias("root")))
    while True:
        on = roots.select(F.col("head").alias("root"), F.col("root").alias("on"))
        if roots.join(on, "root", "left_semi").isEmpty():
            return roots
        roots = cut(roots.join(on, "root", "left").select("head", F.coalesce("on", "root").alias("root")))


def link_names(names: DataFrame, q: int = 3, rows: int = 3, similarity: float = 0.42, recall: float = 0.995,
               most_edits: int = 1, least: float = 0.8, nicknames: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links) of ``names`` (name, uses).

    members has one row per name: name, uses, cluster (the reading that its star is named after), similarity to it, and
    links (the number of other names in the cluster). links has the verified pairs of readings. Null and blank names, and
    names without a letter or digit, are dropped. nicknames: short form to full form of given names; by default NICKNAMES.

    Names that read alike (case, accents, blanks, order, titles, nicknames do not matter) are one node before anything is
    compared, so the pairs grow with the different readings and not with the rows. Two heads are compared if a band of
    their MinHash values agrees; how many bands that takes follows from the collision curve. Whether a head at most
    ``most_edits`` edits from another is its typo follows from the shares of both in their common mass of spellings and uses
    (`least_share`), never from a number of them: a share like that of typos makes it one, the typo of a typo is one of the
    head of most mass, and typos of one head are linked. Two heads of like mass are two real names; so are two given names,
    by the same rule. Where too little is known to tell, heads are linked with up to twice the edits, and their nodes
    must agree in full in the rest. Nodes of linked heads are compared if their first initials agree or one has none, and
    are linked at a Monge-Elkan similarity of ``least``; the nodes of a hot head are salted.
    """
    bands = bands_for(similarity, rows, recall)
    short = NICKNAMES if nicknames is None else nicknames

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            r = pd.DataFrame([read_name(n) for n in p["name"]], columns=["shape", "head", "given", "middle", "kind"], index=p.index)
            r["given"] = [short.get(g, g) if s == "person" else g for s, g in zip(r["shape"], r["given"])]
            yield pd.concat([p, r], axis=1)

    parsed = cut(names.filter("name IS NOT NULL").select("name", "uses").mapInPandas(read, f"name string, uses long, {READ}").filter("head <> ''"))
    key = ["shape", "head", "given", "middle", "kind"]
    heads = cut(parsed.groupBy("head").agg(F.count("*").alias("spelled"), F.sum("uses").alias("used")))
    both = close_words(heads, q, rows, bands, 2 * most_edits)
    roots = typo_roots(both.filter(F.col("apart") <= most_edits))
    heads = heads.join(roots, "head", "left").withColumn("root", F.coalesce("root", "head"))
    near = both.filter("unsure")  # in one of the directions, that from less to more mass
    near = near.select(F.least("head", "head_b").alias("head"), F.greatest("head", "head_b").alias("head_b")).distinct()

    givens = cut(parsed.filter("shape = 'person' AND length(given) > 1").groupBy(F.col("given").alias("head")).agg(F.count("*").alias("spelled"), F.sum("uses").alias("used")))
    near_givens = close_words(givens, q, rows, bands, most_edits)
    misspelt = near_givens.filter("typo").select("head").distinct().withColumn("misspelt", F.lit(True))
    unsure = near_givens.filter("unsure").select("head").distinct().withColumn("unsure", F.lit(True))
    givens = givens.join(misspelt, "head", "left").join(unsure, "head", "left").select(F.col("head").alias("given"), F.col("spelled").alias("known"), F.coalesce("misspelt", F.lit(False)).alias("misspelt"), F.col("unsure").isNull().alias("a_name"))
    nodes = parsed.groupBy(*key).agg(F.sum("uses").alias("uses")).join(heads, "head").join(givens, "given", "left").na.fill(0, ["known"]).na.fill(False, ["misspelt", "a_name"])
    nodes = nodes.withColumn("node", F.xxhash64(*key)).withColumn("initial", F.substring("given", 1, 1))
    # the best centres are complete, their words are no typos, and spelled as many others spell
    full = F.when((F.length("given") > 1) & (F.col("shape") != "short"), F.lit(1)).otherwise(F.lit(0))
    rank = F.struct(full.alias("full"), (F.col("head") == F.col("root")).cast("int").alias("right_head"), (~F.col("misspelt")).cast("int").alias("right_given"), F.col("spelled").alias("head_known"), F.col("known").alias("given_known"), F.length("middle").alias("m"), "uses", "node")
    nodes = cut(nodes.withColumn("rank", rank))

    def of(side: str) -> DataFrame:
        return nodes.select(*[F.col(c).alias(f"{c}_{side}") for c in ["node", "a_name", "initial", "root", *key]])

    def linked(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        """Pairs by equal keys and initials; a node without an initial meets all of its keys."""
        columns = [*a.columns, *b.columns]
        columns = list(dict.fromkeys(c for c in columns if c not in on))
        hot = None if hot_keys(a, on) else []  # where no key is hot, none is with its initial
        equal = salted_join(a.withColumn("__i", F.col("initial_a")), b.withColumn("__i", F.col("initial_b")), [*on, "__i"], F.col("node_a"), "inner", hot=hot).select(*columns)
        left = salted_join(a.filter("initial_a <> ''"), b.filter("initial_b = ''"), on, F.col("node_a"), "inner", hot=hot).select(*columns)
        right = salted_join(a.filter("initial_a = ''"), b.filter("initial_b <> ''"), on, F.col("node_a"), "inner", hot=hot).select(*columns)
        return equal.unionByName(left).unionByName(right)

    a, b = of("a"), of("b")
    same = linked(a.withColumn("__root", F.col("root_a")), b.withColumn("__root", F.col("root_b")), ["__root"]).filter(F.col("node_a") < F.col("node_b"))
    spread = near.join(a.withColumnRenamed("head_a", "head"), "head").withColumnRenamed("head", "head_a").withColumnRenamed("head_b", "__head")
    apart = linked(spread, b.withColumn("__head", F.col("head_b")), ["__head"]).filter(F.col("root_a") != F.col("root_b"))

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for t in p.itertuples(index=False):
                x = (t.shape_a, t.head_a, t.given_a, t.middle_a, t.kind_a)
                y = (t.shape_b, t.head_b, t.given_b, t.middle_b, t.kind_b)
                if x[0] == y[0] == "person" and min(len(x[2]), len(y[2])) > 1 and x[2] != y[2] and t.a_name_a and t.a_name_b:
                    out.append(0.0)  # two given names, neither a typo
                elif t.root_a != t.root_b and edits(x[1], y[1]) > most_edits and not agrees(x, y):
                    out.append(0.0)
                else:
                    out.append(monge_elkan(x, y))
            p = p.assign(similarity=out)
            yield p.loc[p["similarity"] >= least, ["node_a", "node_b", "similarity"]]

    found = same.unionByName(apart).mapInPandas(verify, "node_a long, node_b long, similarity double")
    half = cut(found.select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"), "similarity").distinct())
    links = half.unionByName(half.select(F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b"), "similarity"))
    stars = star_clusters(nodes.select("node", "rank"), links)
    members = parsed.withColumn("node", F.xxhash64(*key)).select("name", "uses", "node").join(stars, "node")
    sizes = members.groupBy("cluster").agg((F.count("*") - 1).alias("links"))
    return members.join(sizes, "cluster").select("name", "uses", "cluster", "similarity", "links"), half


def star_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, cluster, similarity): greedy stars. nodes: (node, rank), links: both directions of (node_a, node_b, similarity).

    In each round every open node that ranks above all its open neighbours becomes a centre, and its open neighbours leave
    with it; the node that ranks highest always does, so the rounds end, and the result is that of going through the nodes
    from the highest rank down. At last each satellite joins the centre that it is most similar to (ties: higher rank).
    """
    ranks = nodes.select(F.col("node").alias("node_b"), F.col("rank").alias("rank_b"))
    edges = cut(links.join(ranks, "node_b").join(nodes.select(F.col("node").alias("node_a"), F.col("rank").alias("rank_a")), "node_a"))
    open_edges, stars = edges, []
    while True:
        beaten = open_edges.filter("rank_b > rank_a").select("node_a").distinct()
        new = cut(open_edges.select("node_a").distinct().join(beaten, "node_a", "left_anti"))
        if new.isEmpty():
            break
        stars.append(new)
        gone = new.unionByName(open_edges.join(new, "node_a", "left_semi").select(F.col("node_b").alias("node_a"))).distinct()
        left = open_edges.join(gone, "node_a", "left_anti")
        # nodes whose neighbours have all left are centres of their own
        kept = left.join(gone.withColumnRenamed("node_a", "node_b"), "node_b", "left_anti")
        stars.append(cut(left.select("node_a").distinct().join(kept.select("node_a").distinct(), "node_a", "left_anti")))
        open_edges = cut(kept)
    centres = nodes.join(edges.select(F.col("node_a").alias("node")).distinct(), "node", "left_anti").select("node")
    for c in stars:
        centres = centres.unionByName(c.select(F.col("node_a").alias("node")))
    centres = cut(centres)
    best = edges.join(centres.withColumnRenamed("node", "node_b"), "node_b", "left_semi").join(centres.withColumnRenamed("node", "node_a"), "node_a", "left_anti")
    best = best.groupBy("node_a").agg(F.max(F.struct("similarity", "rank_b", "node_b")).alias("m")).select(F.col("node_a").alias("node"), F.col("m.node_b").alias("cluster"), F.col("m.similarity").alias("similarity"))
    return centres.select("node", F.col("node").alias("cluster"), F.lit(1.0).alias("similarity")).unionByName(best)


def name_pairs(members: DataFrame) -> DataFrame:
    """(name_a, name_b): every two different names of a cluster, name_a < name_b by bytes."""
    members = cut(members.filter("links > 0").select("cluster", "name"))
    a, b = members.withColumnRenamed("name", "name_a"), members.withColumnRenamed("name", "name_b")
    return salted_join(a, b, ["cluster"], F.col("name_a"), "inner").filter("name_a < name_b").select("name_a", "name_b")
