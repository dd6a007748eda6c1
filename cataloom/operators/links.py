"""Links between pages: extraction, selection, scoring and two-step reachability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, vocab
from ..functions.text import contains_any, count_present, distinctive_tokens
from ..functions.urls import extract_domain, is_blocklisted, netloc, path, same_or_subdomain, trim_slash
from ..session import materialise
from .scale import one_per_key, top_per_key


def extract_links(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(src, pos, dst) for each link of each page."""
    found = pages.select(F.col(url).alias("src"), F.posexplode(html.links(F.col(page), F.col(url))).alias("pos", "dst"))
    return found


def first_external_link(pages: DataFrame, key: str, url: str = "url", page: str = "html") -> DataFrame:
    """First link that leaves the page's own site, per page."""
    links = F.filter(html.links(F.col(page), F.col(url)), lambda x: netloc(x) != netloc(F.col(url)))
    return pages.select(key, F.get(links, F.lit(0)).alias("link"))


def _same_site(target: Column, base: Column) -> Column:
    return (netloc(target) == netloc(base)) | netloc(target).endswith(F.concat(F.lit("."), netloc(base)))


def suggest_links(pages: DataFrame, key: str, url: str = "url", page: str = "html",
                  keywords: Sequence[str] = vocab.SUGGEST_KEYWORDS, limit: int = 8, skip_nav: bool = True) -> DataFrame:
    """Per page, the first ``limit`` distinct same-site links whose address or text has a keyword."""
    base = F.col(url)
    pairs = html.anchors(F.col(page), base) if skip_nav else F.transform(
        html.links(F.col(page), base), lambda x: F.struct(x.alias("url"), F.lit("").alias("text")))
    wanted = F.filter(pairs, lambda r: _same_site(r["url"], base) & (r["url"] != base)
                      & contains_any(F.lower(F.concat(r["url"], F.lit(" "), r["text"])), keywords))
    return pages.select(key, F.posexplode(F.slice(F.array_distinct(F.transform(wanted, lambda r: r["url"])), 1, limit)).alias("pos", "link"))


def candidate_pages(pages: DataFrame, key: str, url: str = "url", page: str = "html",
                    keywords: Sequence[str] = vocab.CANDIDATE_KEYWORDS,
                    exclusions: Sequence[str] = vocab.CANDIDATE_EXCLUSIONS, limit: int = 4, skip_nav: bool = True) -> DataFrame:
    """As suggest_links, without downloads, logins and news, first ``limit``."""
    base = F.col(url)
    pairs = html.anchors(F.col(page), base) if skip_nav else F.transform(
        html.links(F.col(page), base), lambda x: F.struct(x.alias("url"), F.lit("").alias("text")))
    wanted = F.filter(pairs, lambda r: _same_site(r["url"], base) & (r["url"] != base)
                      & contains_any(F.lower(F.concat(r["url"], F.lit(" "), r["text"])), keywords)
                      & ~contains_any(F.lower(r["url"]), exclusions))
    return pages.select(key, F.posexplode(F.slice(F.array_distinct(F.transform(wanted, lambda r: r["url"])), 1, limit)).alias("pos", "link"))


def score_pages(sites: DataFrame, home_links: DataFrame, hits: DataFrame,
                home_keywords: Sequence[str] = vocab.HOME_LINK_KEYWORDS,
                hit_keywords: Sequence[str] = vocab.SEARCH_HIT_KEYWORDS,
                exclusions: Sequence[str] = vocab.HOME_LINK_EXCLUSIONS, limit: int = 4) -> DataFrame:
    """Pages worth reading per entity: homepage, then its best links, then search hits.

    sites(slug, website), home_links(slug, url, pos), hits(slug, url, pos). A page counts once,
    under the first list that names it; ties keep list order.
    """
    home = sites.select("slug", F.col("website").alias("url"), F.lit(0).alias("stage"), F.lit(0).alias("score"), F.lit(0).alias("pos"))
    domain = sites.select("slug", extract_domain(F.col("website")).alias("_domain"))
    tidy = F.regexp_replace(F.split_part(F.trim("url"), F.lit("#"), F.lit(1)), "/+$", "")
    where = F.lower(path(tidy))
    linked = (home_links.join(domain, "slug").where((tidy != "") & same_or_subdomain(tidy, F.col("_domain")))
              .where(~contains_any(where, exclusions))
              .select("slug", "url", F.lit(1).alias("stage"), (10 * count_present(where, home_keywords)).alias("score"), "pos")
              .where("score > 0"))
    spot = F.lower(path(F.col("url")))
    found = (hits.join(domain, "slug").where(same_or_subdomain(F.trim("url"), F.col("_domain")))
             .select("slug", F.trim("url").alias("url"), F.lit(2).alias("stage"), (5 * count_present(spot, hit_keywords)).alias("score"), "pos"))
    every = home.unionByName(linked).unionByName(found)
    every = every.withColumn("url", F.trim("url")).withColumn("_norm", F.regexp_replace("url", "/+$", "")).where("_norm <> ''")
    order = F.struct("stage", (-F.col("score")).alias("neg"), "pos", "url")
    unique = one_per_key(every, ["slug", "_norm"], order, newest=False)
    ranked = top_per_key(unique, ["slug"], [F.col("stage"), F.col("score").desc(), F.col("pos"), F.col("url")], limit)
    return ranked.select("slug", "rank", "url", "score")


def score_candidates(candidates: DataFrame, limit: int = 12) -> DataFrame:
    """candidates(slug, url, tokens, pos): +3 per token in the host, +1 elsewhere in the address."""
    lower = F.lower("url")
    score = F.aggregate("tokens", F.lit(0), lambda acc, t: acc + F.when(F.contains(netloc(F.col("url")), t), 3)
                        .when(F.contains(lower, t), 1).otherwise(0))
    scored = candidates.withColumn("score", score)
    return top_per_key(scored, ["slug"], [F.col("score").desc(), F.col("pos")], limit).select("slug", "rank", "url", "score")


def candidate_domains(entities: DataFrame, slug: str = "slug", name: str = "name", city: str | None = None,
                      tld: str = "nl", blocklist: Sequence[str] = vocab.AGGREGATOR_DOMAINS) -> DataFrame:
    """Guessed site addresses from the key and from name tokens of five letters or more."""
    plain = F.regexp_replace(F.replace(F.replace(F.lower(slug), F.lit("-1"), F.lit("")), F.lit("1"), F.lit("")), "[^a-z0-9]", "")
    tokens = F.filter(distinctive_tokens(F.col(name), F.col(city) if city else None), lambda t: F.length(t) >= 5)
    stems = F.array_distinct(F.concat(F.array(plain), tokens))
    guesses = F.flatten(F.transform(stems, lambda s: F.array(
        F.concat(F.lit("https://www."), s, F.lit(f".{tld}/")), F.concat(F.lit("https://"), s, F.lit(f".{tld}/")))))
    rows = entities.select(F.col(slug).alias("slug"), F.explode(F.array_distinct(guesses)).alias("url"))
    return rows.where(~is_blocklisted(F.col("url"), blocklist))


def link_distance(pairs: DataFrame, edges: DataFrame, depth: int = 2, compat: bool = True) -> DataFrame:
    """pairs(target, origin) -> adds ``steps``, the fewest links over edges(src, dst) from origin to target.

    Zero where they are the same address, null beyond ``depth`` links. Ends are compared without case
    and closing slashes; strict, zero takes the same characters. Nodes are reached step by step: the frontier of a step follows only links from
    which some target is still within the steps left, leaves out what its origin has seen, and is written
    once. The last link is met from the cheaper end of each pair: over the nodes its origin has reached,
    or over the links into its target, so that two hubs are not multiplied out.
    """
    edge = materialise(edges.where("src is not null and dst is not null").select("src", "dst", trim_slash(F.col("dst")).alias("end")).distinct(), "edges")
    want = pairs.select("target", "origin").distinct().withColumn("end", trim_slash(F.col("target")))
    same = trim_slash(F.col("origin")) == F.col("end") if compat else F.col("origin") == F.col("target")
    found = want.where(same).select("target", "origin", F.lit(0).alias("steps"))
    asked = want.where(~same)
    if depth > 0:
        last = edge.join(asked.select("end").distinct(), "end", "left_semi")
        # Links to follow with so many steps left.
        useful = [last]
        for _ in range(depth - 1):
            towards = useful[-1].select(F.col("src").alias("dst")).distinct()
            useful.append(last.unionByName(edge.join(towards, "dst", "left_semi")).distinct())
        frontier = asked.select("origin", F.col("origin").alias("node"), F.lit(0).alias("step")).distinct()
        reached = frontier
        for step in range(1, depth):
            links = useful[depth - step].select(F.col("src").alias("node"), F.col("dst").alias("next"))
            beyond = frontier.join(links, "node").select("origin", F.col("next").alias("node")).distinct()
            frontier = materialise(beyond.join(reached, ["origin", "node"], "left_anti").withColumn("step", F.lit(step)), "frontier")
            reached = reached.unionByName(frontier)
        into = last.select(F.col("src").alias("node"), "end").distinct()
        nodes = reached.groupBy("origin").agg(F.count(F.lit(1)).alias("_nodes"))
        links_in = into.groupBy("end").agg(F.count(F.lit(1)).alias("_links"))
        sized = asked.join(nodes, "origin").join(links_in, "end")
        forward = sized.where("_nodes <= _links").join(reached, "origin").join(into, ["node", "end"], "left_semi")
        backward = sized.where("_nodes > _links").join(into, "end").join(reached, ["origin", "node"])
        hits = forward.select("target", "origin", "step").unionByName(backward.select("target", "origin", "step"))
        found = found.unionByName(hits.groupBy("target", "origin").agg((F.min("step") + 1).alias("steps")))
    return pairs.join(found, ["target", "origin"], "left")


def link_reachable(pairs: DataFrame, edges: DataFrame, depth: int = 2, compat: bool = True) -> DataFrame:
    """pairs(target, origin) -> adds ``reachable``, within ``depth`` links; see `link_distance`."""
    return link_distance(pairs, edges, depth, compat).withColumn("reachable", F.col("steps").isNotNull()).drop("steps")
