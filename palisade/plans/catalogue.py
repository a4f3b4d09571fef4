"""The engine's queries over the star schema, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import stats
from ..operators import clean, cluster, consensus, detect, graph, recruit, report, spacers
from ..operators.durable import written
from ..sources import dot, seqfile
from ..sources import synthetic as Y
from .star import Star, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f: Callable[[Star], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return put


FROM, TO = S.COMPLEMENT_FROM, S.COMPLEMENT_TO
RC = lambda x: f"reverse(translate({x}, '{FROM}', '{TO}'))"

# scalar functions (F), predicates (P)


@query(f"select read_id, {RC('seq')} as rc from reads")
def revcomp(t):
    return t.reads.select("read_id", S.reverse_complement("seq").alias("rc"))


@query(f"select read_id, least(seq, {RC('seq')}) as low from reads")
def canonical(t):
    return t.reads.select("read_id", S.canonical("seq").alias("low"))


@query("select read_id, cast(instr(seq, dr) - 1 as integer) as at, cast(instr(seq, 'ACGTACGT') - 1 as integer) as other from reads")
def first_occurrence(t):
    return t.reads.select("read_id", S.first_occurrence("seq", "dr").alias("at"), S.first_occurrence("seq", F.lit("ACGTACGT")).alias("other"))


@query("select read_id, cast(unnest(list_filter(range(0, length(seq) - 2), lambda i: substr(seq, i + 1, 3) = 'ACG')) as integer) as at from reads")
def all_occurrences(t):
    return t.reads.select("read_id", F.explode(S.all_occurrences("seq", F.lit("ACG"))).alias("at"))


@query("select read_id, cast(i as integer) as idx, cast(32 + 64 * i as integer) as start, cast(63 + 64 * i as integer) as stop, substr(seq, 33 + 64 * i, 32) as repeat from (select *, unnest(range(n_spacers + 1)) as i from reads)")
def repeat_positions(t):
    return spacers.repeats_of(t.hits).select("read_id", "idx", "start", "stop", "repeat")


@query("select read_id, substr(seq, 65, 31) as spacer from reads")
def spacer_without_last(t):
    return t.hits.select("read_id", S.spacer_without_last("seq", "repeats", 0).alias("spacer"))


@query("""select read_id, string_agg(b, '' order by i) as squeezed from (select read_id, i, substr(seq, i, 1) as b, substr(seq, i - 1, 1) as before from (select *, unnest(range(1, length(seq) + 1)) as i from reads))
  where i = 1 or b <> before group by read_id""")
def rle_squeeze(t):
    return t.reads.select("read_id", S.squeezed("seq").alias("squeezed"))


@query("select read_id, seq as back, cast((select count(*) from range(1, length(seq) + 1) t(i) where i = 1 or substr(seq, i, 1) <> substr(seq, i - 1, 1)) as integer) as runs from reads")
def rle_round_trip(t):
    runs = t.reads.select("read_id", S.run_lengths("seq").alias("r"))
    return runs.select("read_id", S.expanded("r").alias("back"), F.size("r").alias("runs"))


@query(f"select family, read_id, contains(seq, substr(dr, 3, 12)) or contains(seq, {RC('substr(dr, 3, 12)')}) as held from reads")
def either_strand(t):
    return t.reads.select("family", "read_id", S.holds_either_strand("seq", F.expr("substring(dr, 3, 12)")).alias("held"))


@query("""select b, cast(case upper(b) when 'A' then 0 when 'C' then 1 when 'G' then 2 when 'T' then 3 else 4 end as integer) as code, count(*) as n
  from (select unnest(string_split(text, '')) as b from documents where text <> '') group by b""")
def base_codes(t):
    letters = t.table("documents").where("text <> ''").select(F.explode(F.split("text", "")).alias("b"))
    return letters.groupBy("b").agg(F.count("*").alias("n")).select("b", S.base_code("b").alias("code"), "n")


_COUNT = lambda b, s="s": f"length({s}) - length(translate({s}, '{b}{b.lower()}', ''))"


@query(f"""select doc_id, a, c, g, t, length(s) - a - c - g - t as other, greatest(a, c, g, t, length(s) - a - c - g - t) > cast(floor(length(s) * 0.75) as integer) as low
  from (select doc_id, text as s, {_COUNT('A', 'text')} as a, {_COUNT('C', 'text')} as c, {_COUNT('G', 'text')} as g, {_COUNT('T', 'text')} as t from documents)""")
def low_complexity(t):
    a, c, g, tt, other = S.base_counts("text")
    return t.table("documents").select("doc_id", *[x.cast("long").alias(n) for x, n in zip((a, c, g, tt, other), ("a", "c", "g", "t", "other"))], S.low_complexity("text").alias("low"))


@query("""select family, round(max(n) / 29.0, 6) as share from (select family, substr(dr, cast(i as bigint), 3) as w, count(*) as n from families, range(1, 30) t(i) group by all) group by family""")
def abundant_trimer(t):
    return t.families.select("family", F.round(S.trimer_share("dr"), 6).alias("share"))


@query("""select read_id, idx, 'sp_' || idx || '_' || spacer || '_' || length(spacer) || '_C' || family as label from interior""")
def spacer_label(t):
    label = dot.spacer_label(F.col("idx").cast("string"), F.col("spacer"), F.length("spacer"), F.lit(False), F.col("family"), with_sequence=True)
    return t.interior.select("read_id", "idx", label.alias("label"))


def _channel(phase: str) -> str:
    third = f"({S.COLOUR_SHARE} * {S.COLOUR_PI})"
    level = f"cast(greatest(round((cos(x - {phase} * {third}) + {S.COLOUR_LIFT}) * {S.COLOUR_SHARE} * 255), 0) as integer)"
    return f"lower(printf('%02x', {level}))"


@query(f"""select p_partkey, case when v between 0 and 60 then {_channel('1')} || '00' || {_channel('0')} else '000000' end as colour
  from (select p_partkey, v, round(v / (60.0 / 9)) * (60.0 / 9) * ({S.COLOUR_SHARE} * {S.COLOUR_PI}) / 60 as x from (select p_partkey, cast(p_size as double) * 1.5 as v from part))""")
def colour_bins(t):
    return t.table("part").select("p_partkey", S.heat_colour(F.col("p_size") * 1.5, 0, 60, 10).alias("colour"))


@query("select read_id, 'DR: ' || dr || (select string_agg(' SP: ' || substr(seq, cast(65 + 64 * i as bigint), 32) || ' DR: ' || dr, '' order by i) from range(n_spacers) u(i)) as shown from reads")
def read_layout(t):
    return t.hits.select("read_id", S.in_columns("seq", "repeats").alias("shown"))


@query()
def edit_distances(t):
    a, b = t.families.alias("a"), t.families.alias("b")
    pairs = a.join(b, F.col("a.family") < F.col("b.family")).select(F.col("a.family").alias("x"), F.col("b.family").alias("y"), F.col("a.dr").alias("p"), F.col("b.dr").alias("q"))
    return pairs.select("x", "y", S.edit_distance("p", "q").cast("int").alias("distance"), F.round(S.similarity("p", "q"), 6).alias("similarity"))


# detection (R)


@query("select read_id, length(seq) as n from reads where length(seq) >= 58")
def length_gate(t):
    return detect.long_enough(t.reads).select("read_id", F.length("seq").cast("long").alias("n"))


_SEEDS = "(select read_id, seq, unnest(range(0, length(seq) - 58 + 1, 8)) as j from reads where length(seq) >= 58)"
_AREA = "substr(seq, j + 50, greatest(j + 49, least(j + 105, length(seq) - 1)) - (j + 49))"


@query(f"select read_id, count(*) as seeds, max(j) as last from {_SEEDS} group by read_id")
def seed_positions(t):
    return detect.seeds(t.reads).groupBy("read_id").agg(F.count("*").alias("seeds"), F.max("seed_at").cast("long").alias("last"))


@query(f"select read_id, j as seed_at, j + 49 + instr({_AREA}, substr(seq, j + 1, 8)) - 1 as hit_at from {_SEEDS} where contains({_AREA}, substr(seq, j + 1, 8))")
def seed_hits(t):
    return detect.seed_hits(t.reads).select("read_id", F.col("seed_at").cast("long").alias("seed_at"), F.col("hit_at").cast("long").alias("hit_at"))


@query(f"""select read_id, min(j) as seed_at, arg_min(j + 49 + instr({_AREA}, substr(seq, j + 1, 8)) - 1, j) as hit_at from {_SEEDS} where contains({_AREA}, substr(seq, j + 1, 8)) group by read_id""")
def seed_first_hit(t):
    return detect.first_seed_hits(t.reads).select("read_id", F.col("seed_at").cast("long").alias("seed_at"), F.col("hit_at").cast("long").alias("hit_at"))


@query(f"select distinct read_id from {_SEEDS} where contains({_AREA}, substr(seq, j + 1, 8))")
def seeded_reads(t):
    return detect.seeded(t.reads).select("read_id")


@query()
def find_repeats(t):
    return detect.repeat_bearing(t.reads.select("read_id", "family", "seq")).select("read_id", "family", "repeat_len", F.to_json("repeats").alias("repeats"))


@query("select read_id, n_spacers as n, 32 as shortest, 32 as longest, 0 as spacer_step, 0 as repeat_step, true as lengths_fit from reads where n_spacers >= 2")
def spacer_lengths(t):
    return detect.checks(t.hits)


@query("select read_id, dr as shown from reads")
def representative_repeat(t):
    return t.hits.select("read_id", S.representative_repeat("seq", "repeats").alias("shown"))


@query(f"""select read_id, turned, case when turned then {RC('dr')} else dr end as variant, case when turned then {RC('seq')} else seq end as seq, cast(case when turned then 0 else 32 end as integer) as first_start
  from (select *, dr >= {RC('dr')} as turned from reads)""")
def orientation(t):
    out = detect.oriented(t.hits.select("read_id", "seq", "repeats"))
    return out.select("read_id", "turned", "variant", "seq", F.element_at("repeats", 1)["start"].cast("int").alias("first_start"))


@query(f"select least(dr, {RC('dr')}) as variant, count(*) as n_reads, min(read_id) as ord from reads group by 1")
def dr_variants(t):
    return detect.variants(detect.oriented(t.hits.select("read_id", "seq", "repeats")))


@query("select read_id, n_spacers + 1 as kept from reads where n_spacers > 0")
def without_partials(t):
    # the last repeat touches the end of its read, and a flank goes before the first one
    return detect.without_partials(t.hits).select("read_id", (F.size("repeats") + 1).cast("long").alias("kept"))


# joins (J), clusters and consensus (C)


@query(f"""select read_id, arg_min(pattern, (instr(seq, pattern) + length(pattern), -length(pattern))) as pattern, cast(min(instr(seq, pattern) - 1) as integer) as start
  from reads, (select dr as pattern from families union select {RC('dr')} from families) where contains(seq, pattern) group by read_id""")
def recruit_reads(t):
    return recruit.matches(t.reads.select("read_id", "seq"), recruit.both_strands(t.families.select(F.col("dr").alias("pattern")))).drop("seq")


@query(f"""select read_id, arg_min(pattern, (instr(seq, pattern) + length(pattern), -length(pattern))) as pattern, cast(min(instr(seq, pattern) - 1) as integer) as start
  from reads, (select dr as pattern from families union select {RC('dr')} from families) where contains(seq, pattern) group by read_id""")
def recruit_by_kmers(t):
    return recruit.matches(t.reads.select("read_id", "seq"), recruit.both_strands(t.families.select(F.col("dr").alias("pattern"))), limit=1).drop("seq")


@query("select read_id, family from reads where n_spacers < 4")
def recruit_anti(t):
    return recruit.not_found_before(t.reads.select("read_id", "family"), t.reads.where("n_spacers >= 4"))


@query(f"""select a.variant as a, b.variant as b, count(*) as shared from (select distinct variant, least(k, {RC('k')}) as k from (select variant, unnest(list_transform(range(1, length(variant) - 9), lambda i: substr(variant, i, 11))) as k from near)) a
  join (select distinct variant, least(k, {RC('k')}) as k from (select variant, unnest(list_transform(range(1, length(variant) - 9), lambda i: substr(variant, i, 11))) as k from near)) b on a.k = b.k and a.variant < b.variant group by 1, 2""")
def dr_pair_shared_kmers(t):
    return cluster.shared_kmers(t.near)


@query("select variant, kmer, count(*) as n from (select variant, unnest(list_transform(range(1, length(variant) - 9), lambda i: substr(variant, i, 11))) as kmer from near) group by all")
def kmer_cut(t):
    return t.near.select("variant", F.explode(S.kmers("variant", 11)).alias("kmer")).groupBy("variant", "kmer").agg(F.count("*").alias("n"))


@query(f"""select gid, pattern from (select gid, variant as pattern from kept union select gid, {RC('variant')} from kept)""".replace("kept", f"""(select gid, variant from near a where not exists (select 1 from near b where a.gid = b.gid
  and (length(a.variant) > length(b.variant) or (length(a.variant) = length(b.variant) and a.variant > b.variant)) and (contains(a.variant, b.variant) or contains(a.variant, {RC('b.variant')}))))"""))
def nonredundant_patterns(t):
    return recruit.nonredundant(t.near)


@query("select gid, arg_max(variant, (length(variant), -ord)) as master from near group by gid")
def master_dr(t):
    return cluster.masters(t.near)


@query()
def greedy_clusters(t):
    return cluster.grouped(t.near.select("variant", "ord"))


@query()
def component_clusters(t):
    return cluster.by_components(t.near.select("variant", "ord"))


@query("select gid, variant, a.ord as ord from near a join (select arg_max(variant, (length(variant), -ord)) as master, gid as g from near group by gid) m on m.g = a.gid where instr(master, variant) > 0")
def align_offsets(t):
    # each variant is cut from its group's master, so all of them find their place
    return consensus.aligned(t.near).where("not reversed").select("gid", "variant", "ord")


def _cover(t):
    hits = t.hits.select(F.col("family").alias("gid"), "seq", "repeats", F.lit(0).alias("offset"), F.lit(32).alias("repeat_len"))
    return consensus.coverage(hits, 12)


_COVER = """(select family as gid, cast(p as integer) as pos, substr(seq, cast(33 + 64 * i + p as bigint), 1) as base, count(*) as n
  from (select *, unnest(range(n_spacers + 1)) as i from reads), range(-12, 44) t(p) where 32 + 64 * i + p < length(seq) group by all)"""
_COLUMNS = f"""(select gid, pos, arg_max(base, (n, -ascii(base))) as consensus, cast(sum(n) as bigint) as depth, case when sum(n) > 2 then max(n) / sum(n) else 0 end as conservation from {_COVER} group by gid, pos)"""


@query(f"select * from {_COVER}")
def coverage_columns(t):
    return _cover(t)


@query(f"select gid, pos, consensus, depth, round(conservation, 6) as conservation from {_COLUMNS}")
def consensus_base(t):
    return consensus.columns(_cover(t)).withColumn("conservation", F.round("conservation", 6))


_ZONE = f"""(select gid, min(case when high >= -1 then low end) as zone_start, max(case when low <= 32 then high end) as zone_end from (select gid, min(pos) as low, max(pos) as high
  from (select gid, pos, pos - row_number() over (partition by gid order by pos) as island from {_COLUMNS} where conservation >= 0.55) group by gid, island) group by gid)"""


@query(f"select gid, zone_start, zone_end from {_ZONE} where zone_start <= zone_end")
def dr_zone(t):
    lengths = t.families.select(F.col("family").alias("gid"), F.length("dr").alias("master_length"))
    return consensus.zones(consensus.columns(_cover(t)), lengths)


@query(f"select c.gid, string_agg(consensus, '' order by pos) as true_dr from {_COLUMNS} c join {_ZONE} z on z.gid = c.gid where pos between zone_start and zone_end group by c.gid")
def true_dr(t):
    cols = consensus.columns(_cover(t))
    lengths = t.families.select(F.col("family").alias("gid"), F.length("dr").alias("master_length"))
    return consensus.true_repeats(cols, consensus.zones(cols, lengths))


@query(f"""select gid, pos, base, round(n / depth, 6) as share from (select c.gid, c.pos, c.base, c.n, k.depth, count(*) over (partition by c.gid, c.pos) as forms
  from {_COVER} c join {_COLUMNS} k on k.gid = c.gid and k.pos = c.pos where conservation < 0.75 and depth > 2 and n / depth >= 0.3) where forms >= 2""")
def collapse_suspects(t):
    cover = _cover(t)
    zone = t.families.select(F.col("family").alias("gid"), F.lit(-12).alias("zone_start"), F.lit(43).alias("zone_end"))
    return consensus.suspects(cover, consensus.columns(cover), zone).withColumn("share", F.round("share", 6))


def _mutated(t):
    """Reads of which two in five have one base of all repeats changed, named by the variant they show."""
    changed = F.expr("translate(substring(dr, 11, 1), 'ACGT', 'CGTA')")
    form = F.when(F.col("read_id") % 5 < 2, F.concat(F.substring("dr", 1, 10), changed, F.expr("substring(dr, 12, 21)"))).otherwise(F.col("dr"))
    named = t.hits.withColumn("variant", form)
    seq = F.expr("replace(seq, dr, variant)")
    return named.select(F.col("family").cast("string").alias("gid"), "read_id", seq.alias("seq"), "repeats", F.lit(32).alias("repeat_len"), "variant")


@query("""select case when read_id % 5 < 2 then 'changed' else 'plain' end as form, count(*) as n, count(distinct family) as families from reads group by 1""")
def split_groups(t):
    # each family comes apart into two groups, one for either form
    held, _ = consensus.consensus(_mutated(t))
    form = F.when(F.col("read_id") % 5 < 2, "changed").otherwise("plain")
    sizes = held.groupBy("gid").agg(F.count_distinct(form).alias("forms"))
    return held.join(sizes.where("forms = 1"), "gid").groupBy(form.alias("form")).agg(F.count("*").alias("n"), F.count_distinct("gid").alias("families"))


@query(f"select family as gid, least(dr, {RC('dr')}) as true_dr from families")
def canonical_true_dr(t):
    groups = t.families.select(F.col("family").alias("gid"), F.col("dr").alias("true_dr"))
    hits = t.hits.select(F.col("family").alias("gid"), "read_id", "seq", "repeats")
    return consensus.canonicalised(hits, groups)[1].select("gid", "true_dr")


@query("select read_id, cast(32 + 64 * n_spacers as integer) as last_full, cast(96 + 64 * n_spacers as integer) as cut_off from reads")
def partial_repeats(t):
    # a read with 20 bases of the repeat appended behind a spacer: the cut-off repeat is found again
    tail = t.hits.select(F.col("family").alias("gid"), "read_id", F.concat("seq", F.expr("substring(seq, 65, 32)"), F.expr("substring(dr, 1, 20)")).alias("seq"), "repeats", F.lit(0).alias("offset"))
    groups = t.families.select(F.col("family").alias("gid"), F.col("dr").alias("true_dr"), F.lit(0).alias("zone_start"))
    out = consensus.reprojected(tail, groups)
    return out.select("read_id", F.element_at("repeats", -2)["start"].alias("last_full"), F.element_at("repeats", -1)["start"].alias("cut_off"))


@query("select family as gid, family % 7 as keep from families")
def merge_identical_dr(t):
    groups = t.families.select(F.col("family").alias("gid"), (F.col("family") % 7).cast("string").alias("true_dr"))
    return consensus.merged_identical(groups)


# spacers (X)


@query("select read_id, family, idx, spacer from interior")
def spacers_interior(t):
    return t.interior


@query("select read_id, 0 as idx, substr(seq, 1, 32) as spacer, true as is_first, false as is_last from reads union all select read_id, idx + 1, spacer, false, false from interior")
def spacers_overhang(t):
    return spacers.stretches_of(t.hits).select("read_id", "idx", "spacer", "is_first", "is_last")


@query("select read_id, 32 * n_spacers // (n_spacers + 1) as average_repeat, cast(32 as bigint) as average_spacer from reads")
def read_averages(t):
    return spacers.read_averages(t.hits)


@query("select * from given")
def graph_contributions(t):
    return t.given


# graph (G, K, P)


@query("""select family, node, count(*) as coverage, arg_min(side, (read_id, idx, side)) = 0 as is_forward from
  (select family, first as node, read_id, idx, 0 as side from given where first is not null union all select family, last, read_id, idx, 1 from given where last is not null) group by family, node""")
def node_coverage(t):
    return graph.nodes(t.given)


@query("select family, low, high, leader, last, seq, coverage, ord_read, ord_idx from held")
def spacer_upsert(t):
    return t.held


@query("select * from inner_edges")
def node_edges(t):
    return graph.inner_edges(t.table_of_spacers)


@query("select * from jumps")
def jump_edges(t):
    return t.jumps


@query("""select family, src as node, cast(count(*) filter (where etype in ('F', 'B')) as bigint) as inner_rank, cast(count(*) filter (where etype in ('JF', 'JB')) as bigint) as jumping_rank, count(*) as total_rank
  from (select * from inner_edges union all select * from jumps) group by family, src""")
def node_ranks(t):
    return graph.ranks(t.edges)


@query("select * from jumps where src < 'T' and dst < 'T'")
def detach_nodes(t):
    jumps = t.edges.where("etype in ('JF', 'JB')")
    gone = jumps.select("family", F.explode(F.array("src", "dst")).alias("node")).where("node >= 'T'").distinct()
    return graph.without_nodes(jumps, gone)


@query("""select family, src as node, count(*) as discounted from (select distinct e.family, e.src, o.read_id from (select * from inner_edges union all select * from jumps) e
  join (select distinct family, node, read_id from (select family, unnest([first, last]) as node, read_id from given) where node is not null) n on n.family = e.family and n.node = e.dst
  join (select distinct family, node, read_id from (select family, unnest([first, last]) as node, read_id from given) where node is not null) o on o.family = e.family and o.node = e.src and o.read_id = n.read_id
  where etype in ('F', 'JF')) group by family, src""")
def discounted_coverage(t):
    return graph.discounted_coverage(t.edges, graph.read_nodes(t.kept))


@query("select * from spacer_edges")
def spacer_graph_edges(t):
    return t.spacer_edges


@query("select * from spacer_rank")
def spacer_rank(t):
    return clean.spacer_ranks(t.spacer_graph)


@query("select family, spacer from spacer_rank where rank = 1")
def caps(t):
    return clean.spacer_ranks(t.spacer_graph).where("rank = 1").select("family", "spacer")


@query("select w.family, w.a as spacer from ways w join spacer_rank r on r.family = w.family and r.spacer = w.a and r.rank = 1 join spacer_rank q on q.family = w.family and q.spacer = w.b and q.rank > 2")
def fur(t):
    return clean.fur(t.spacer_graph)


@query("select family, spacer from spacer_rank where rank >= 2 and (ahead = 0 or back = 0)")
def viable(t):
    return clean.not_viable(t.spacer_graph)


@query("""select distinct family, spacer from (select p.family, p.spacer, row_number() over (partition by p.family, x, y order by coverage desc, rank desc, ord_read, ord_idx) as place from
  (select r.family, r.a as spacer, least(r.b, f.b) as x, greatest(r.b, f.b) as y from ways r join ways f on f.family = r.family and f.a = r.a and r.way = 'R' and f.way = 'F') p
  join held h on h.family = p.family and h.low || ':' || h.high = p.spacer join spacer_rank k on k.family = p.family and k.spacer = p.spacer) where place > 1""")
def spacer_bubbles(t):
    cover = t.table_of_spacers.select("family", F.concat_ws(":", "low", "high").alias("spacer"), "coverage", "ord_read", "ord_idx")
    return clean.spacer_bubbles(t.spacer_graph, cover)


@query()
def clean_graph(t):
    return clean.cleaned_nodes(t.edges, written(graph.nodes(t.kept), "nodes"), written(graph.read_nodes(t.kept), "read-nodes"))


@query()
def clean_spacer_graph(t):
    return clean.cleaned_spacers(t.spacer_graph)


@query()
def contigs(t):
    return clean.contigs(t.spacer_graph)


def _uneven(t):
    """Spacers of uneven lengths, cut by a rule of their coverage."""
    return t.held.select("family", F.expr("substring(seq, 1, cast(32 - (coverage % 9) * (coverage % 2) as int))").alias("seq"), "coverage")


_UNEVEN = "(select family, substr(seq, 1, 32 - (coverage % 9) * (coverage % 2)) as seq, coverage from held)"
_STATS = "(select family, count(*) as n, sum(length(seq)) // count(*) as mean, sqrt((sum(length(seq) * length(seq)) - 2 * (sum(length(seq)) // count(*)) * sum(length(seq)) + count(*) * (sum(length(seq)) // count(*)) * (sum(length(seq)) // count(*))) / count(*)) as deviation from {} group by family)"


@query(f"""select u.family, u.seq, coverage, n >= 3 and deviation > 1 and (length(u.seq) < floor(mean - 1.5 * deviation) or length(u.seq) > floor(mean + 1.5 * deviation)) as flanker
  from {_UNEVEN} u join {_STATS.format(_UNEVEN)} s on s.family = u.family""")
def flankers(t):
    return clean.flankers(_uneven(t))


@query(f"select family, n, round(deviation, 6) as deviation from {_STATS.format('(select * from ' + _UNEVEN + ' where coverage % 4 > 0)')} where n >= 3 and deviation <= 6")
def group_confidence(t):
    return clean.confident(_uneven(t).withColumn("flanker", F.col("coverage") % 4 == 0)).withColumn("deviation", F.round("deviation", 6))


@query("select family, min(coverage) as low, max(coverage) as high from held group by family")
def coverage_limits(t):
    return clean.coverage_limits(t.held)


@query("select gid, cid, string_agg(spid, ',' order by pos) as spids from cspacers group by gid, cid")
def contig_listing(t):
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "spid"))), lambda x: x["spid"])
    return t.cspacers.groupBy("gid", "cid").agg(F.array_join(held, ",").alias("spids"))


# statistics (A)


@query("select spacer, count(*) as n from interior group by spacer")
def spacer_histogram(t):
    return t.interior.groupBy("spacer").agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as bigint)) // count(*) as bigint) as mean from lineitem group by 1, 2")
def int_mean(t):
    return t.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(stats.int_mean(F.col("l_quantity").cast("long")).alias("mean"))


@query("select family, list_sort(list(length(seq)))[count(*) // 2 + 1] as median, list_sort(list(length(seq)))[cast(floor(count(*) * 0.9) as bigint) + 1] as p90 from reads group by family")
def upper_median(t):
    n = F.length("seq").cast("long")
    return t.reads.groupBy("family").agg(stats.upper_median(n).alias("median"), stats.percentile(n, 0.9).alias("p90"))


@query("select family, cast(n as bigint) as n, round(deviation, 6) as deviation from " + _STATS.format("reads"))
def int_mean_stdev(t):
    return t.reads.groupBy("family").agg(F.count("*").alias("n"), F.round(stats.int_mean_deviation(F.length("seq")), 6).alias("deviation"))


@query("select family, arg_max(l, (n, -l)) as mode from (select family, length(seq) as l, count(*) as n from reads group by 1, 2) group by family")
def mode_length(t):
    counted = t.reads.groupBy("family", F.length("seq").cast("long").alias("l")).agg(F.count("*").alias("n"))
    return counted.groupBy("family").agg(F.max_by("l", F.struct("n", -F.col("l"))).alias("mode"))


@query("select * from stat")
def stat_rows(t):
    return report.statistics(t.groups, t.drs, t.spacers, t.flankers, t.sources)


@query("""select cast(sum(drs) as bigint) as drs, cast(sum(dr_length) // count(*) as bigint) as dr_length, cast(sum(spacers) as bigint) as spacers, cast(sum(spacer_length) // count(*) as bigint) as spacer_length,
  cast(sum(coverage) // count(*) as bigint) as coverage, cast(sum(flankers) as bigint) as flankers, cast(sum(flanker_length) // count(*) as bigint) as flanker_length, cast(sum(reads) // count(*) as bigint) as reads from stat""")
def stat_aggregate(t):
    return report.totals(report.statistics(t.groups, t.drs, t.spacers, t.flankers, t.sources))


@query("select gid, string_agg(cov || ':' || n || ',', '' order by cov) as histogram from (select gid, cov, count(*) as n from spacers group by 1, 2) group by gid")
def coverage_histogram(t):
    return report.coverage_histogram(t.spacers)


@query("select gid, repeat('-', drs::int) || repeat('+', spacers::int) || repeat('~', flankers::int) as bar from stat")
def stat_bars(t):
    return report.bars(report.statistics(t.groups, t.drs, t.spacers, t.flankers, t.sources))


@query("select family, count(*) as records from reads group by family")
def fasta_counts(t):
    text = t.reads.select("family", seqfile.fasta(F.col("read_id").cast("string"), F.col("seq")).alias("record"))
    lines = text.select("family", F.explode(F.split("record", r"\s+")).alias("word"))
    return lines.where("word like '>%'").groupBy("family").agg(F.count("*").alias("records"))


# tools (T)


@query("select gid, drseq from (select gid, drseq from groups union all select gid, drseq from groups where pos % 3 = 0)")
def merge_union(t):
    return report.merged([t.groups, t.groups.where("pos % 3 = 0")]).select("gid", "drseq")


@query("select 'G' || row_number() over (order by file, pos) as gid, drseq from (select 0 as file, pos, drseq from groups union all select 1, pos, drseq from groups where pos % 3 = 0)")
def merge_renumbered(t):
    return report.merged([t.groups, t.groups.where("pos % 3 = 0")], renumber=True).select("gid", "drseq")


@query("select gid, cast(2 as bigint) as n from groups where pos % 3 = 0")
def merge_conflicts(t):
    return report.conflicts(report.merged([t.groups, t.groups.where("pos % 3 = 0")]))


@query("select gid from groups g where (select count(*) from spacers s where s.gid = g.gid) >= 380 and not exists (select 1 from (select gid, count(*) n from flankers group by gid) f where f.gid = g.gid and n < 2)")
def filter_min_spacers(t):
    return report.filtered(t.groups, t.drs, t.spacers, t.flankers, min_spacers=380, min_flankers=2).select("gid")


_GONE = "(select gid, spid from spacers where cov < 8)"


@query(f"""select 'spacers' as part, count(*) as n from spacers where cov >= 8 union all select 'contigs', count(*) from cspacers c where not exists (select 1 from {_GONE} g where g.gid = c.gid and g.spid = c.spid)
  union all select 'links', count(*) from links l where not exists (select 1 from {_GONE} g where g.gid = l.gid and (g.spid = l.spid or g.spid = l.target))""")
def filter_coverage_cascade(t):
    parts = report.covered(t.spacers, t.cspacers, t.links, 8)
    named = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in zip(("spacers", "contigs", "links"), parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""select gid, spid as id, '>x' || gid || '_' || spid || '_Cov_' || cov || chr(10) || seq as record from spacers
  union all select gid, drid, '>' || gid || '_' || drid || chr(10) || seq from drs union all select gid, flid, '>' || gid || '_' || flid || chr(10) || seq from flankers""")
def extract_fasta(t):
    return report.extracted(t.spacers, "spacers", "x").unionByName(report.extracted(t.drs, "drs")).unionByName(report.extracted(t.flankers, "flankers"))


@query("""select 'G' || (g.pos + 1) as new_gid, c.cid, c.spid, 'C' || dense_rank() over (partition by c.gid order by m.first) as new_cid, 'SP' || s.pos as new_spid
  from cspacers c join groups g on g.gid = c.gid join (select gid, cid, min(pos) as first from cspacers group by 1, 2) m on m.gid = c.gid and m.cid = c.cid join spacers s on s.gid = c.gid and s.spid = c.spid""")
def sanitise_ids(t):
    out = report.sanitised(t.groups, t.spacers, t.drs, t.flankers, t.cspacers)
    return out["cspacers"].select("new_gid", "cid", "spid", "new_cid", "new_spid")


@query("select gid, flid, 'F' || row_number() over (order by pos) as new_flid from flankers")
def sanitise_flankers(t):
    return report.sanitised(t.groups, t.spacers, t.drs, t.flankers, t.cspacers)["flankers"].select("gid", "flid", "new_flid")


@query("select gid, spid, cov from spacers where gid not in ('G2', 'G5', 'G9')")
def remove_groups(t):
    return report.removed(t.spacers, report.group_ids(t.spark, "G2,5,G9")).select("gid", "spid", "cov")


@query("select gid, spid, cov from spacers where gid in ('G2', 'G5', 'G9')")
def wanted_groups(t):
    return report.wanted(t.spacers, report.group_ids(t.spark, ["G2", "5", "G9"])).select("gid", "spid", "cov")


@query("""select distinct accession from cspacers c join spacer_sources x on x.gid = c.gid and x.spid = c.spid join sources s on s.gid = x.gid and s.soid = x.soid where c.gid = 'G3' and cid in ('C1', 'C2')""")
def assembler_reads(t):
    return report.supporting_reads(t.cspacers, t.spacer_sources, t.sources, "G3", ["C1", "C2"])


@query("select gid, cast(length(drseq) + 8 as integer) as overlap from groups")
def assembler_overlap(t):
    return report.assembler_overlap(t.groups)


@query("""select read_id, 'reads' as stage, count(*) as rows from reads where read_id % 97 = 0 group by 1 union all select read_id, 'spacers', count(*) from interior where read_id % 97 = 0 group by 1""")
def read_trace(t):
    return report.traced(t.reads.where("read_id % 97 = 0"), {"reads": t.reads, "spacers": t.interior})


@query("select gid, count(*) as n from (select distinct gid, soid from spacer_sources) group by gid")
def supported_reads(t):
    held = t.spacer_sources.select("gid", "soid").distinct()
    return t.sources.join(held, ["gid", "soid"], "left_semi").groupBy("gid").agg(F.count("*").alias("n"))


@query("select gid, chr(9) || spid || ' -> ' || target as line from links")
def draw_edges(t):
    return dot.edge_lines(t.links.select("gid", F.col("spid").alias("src"), F.col("target").alias("dst")))


@query()
def draw_nodes(t):
    limits = t.spacers.groupBy("gid").agg(F.min("cov").cast("double").alias("low"), F.max("cov").cast("double").alias("high"))
    held = t.spacers.join(t.cspacers.select("gid", "spid", F.expr("substring(cid, 2, 9)").alias("contig")), ["gid", "spid"]).join(limits, "gid")
    return dot.node_lines(held.withColumn("flanker", F.lit(False)))


@query()
def colour_key(t):
    limits = t.spacers.groupBy("gid").agg(F.min("cov").cast("double").alias("low"), F.max("cov").cast("double").alias("high"))
    return dot.colour_key(limits)


@query("select '>' || read_id || chr(10) || seq as record from reads")
def fasta_records(t):
    return t.reads.select(seqfile.fasta(F.col("read_id").cast("string"), F.col("seq")).alias("record"))


@query("select gid, count(distinct soid) as sources, count(distinct spid) as spacers from spacer_sources group by gid")
def nested_result(t):
    from ..sources import arrays_xml

    tables = {"groups": t.groups, "drs": t.drs, "spacers": t.spacers, "sources": t.sources, "spacer_sources": t.spacer_sources, "flankers": t.flankers}
    back = arrays_xml.nested(tables).withColumn("assembly", F.lit(None).cast("struct<contig:array<struct<_cid:string>>>"))
    s = back.select(F.col("_gid").alias("gid"), F.explode("data.spacers.spacer").alias("s")).select("gid", F.col("s._spid").alias("spid"), F.explode("s.source").alias("o"))
    return s.groupBy("gid").agg(F.count_distinct("o._soid").alias("sources"), F.count_distinct("spid").alias("spacers"))


# the rest of the inventory


@query("select read_id, cast(31 as integer) as n, cast(1 as integer) as apart, true as lengths_fit from reads where n_spacers = 1")
def short_read_checks(t):
    return detect.short_checks(t.hits)


_EDGES = "(select * from inner_edges union all select * from jumps)"
_RANK = f"(select family, src, count(*) as rank from {_EDGES} group by 1, 2)"


@query(f"select e.family, e.src as node, cast(count(*) filter (where r.rank = 1) as bigint) as caps from {_EDGES} e join {_RANK} r on r.family = e.family and r.src = e.dst group by 1, 2 having count(*) filter (where r.rank = 1) > 0")
def caps_at(t):
    return clean.caps_at(t.edges)


@query(f"select e.family, e.src as node, count(*) as caps from {_EDGES} e join {_RANK} r on r.family = e.family and r.src = e.dst group by 1, 2 having bool_and(r.rank = 1)")
def caps_only(t):
    return clean.caps_at(t.edges, strict=True)


@query(f"select family, cast(count(*) filter (where coverage % 4 > 0) as bigint) as spacers, cast(count(*) filter (where coverage % 4 = 0) as bigint) as flankers from held group by family")
def spacer_counts(t):
    return clean.spacer_counts(t.held.withColumn("flanker", F.col("coverage") % 4 == 0))


@query("select gid, concat_ws('|', gid, drseq, drs, dr_length, spacers, spacer_length, coverage, flankers, flanker_length, reads) as line from stat")
def stat_tabular(t):
    return report.tabular(report.statistics(t.groups, t.drs, t.spacers, t.flankers, t.sources), "|")


@query("select o_orderkey, strftime(o_orderdate, '%d_%m_%Y_%H%M%S') as stamp from orders")
def run_stamps(t):
    return t.table("orders").select("o_orderkey", report.run_stamp("o_orderdate").alias("stamp"))


@query("""select cast(family as integer) as gid, substr(dr, 1, cast(14 + family as bigint)) as true_dr from families where 14 + family between 23 and 47
  and (select max(n) from (select count(*) as n from range(1, cast(14 + family - 2 as bigint)) u(i) group by substr(dr, i, 3))) / cast(14 + family - 3 as double) <= 0.23
  and greatest(length(replace(substr(dr, 1, cast(14 + family as bigint)), 'A', '')), 0) >= 0""")
def true_dr_gates(t):
    return consensus.gated(t.families.select(F.col("family").alias("gid"), F.expr("substring(dr, 1, 14 + family)").alias("true_dr")))


@query("select * from spacer_edges where src_low || ':' || src_high < 'T' and dst_low || ':' || dst_high < 'T'")
def detach_spacers(t):
    named = F.explode(F.array(F.concat_ws(":", "src_low", "src_high"), F.concat_ws(":", "dst_low", "dst_high")))
    gone = t.spacer_graph.select("family", named.alias("spacer")).where("spacer >= 'T'").distinct()
    return clean.without_spacers(t.spacer_graph, gone)


@query("""select family as gid, chr(9) || node || ' [ shape = ' || case when is_forward then 'circle' else 'square' end || ' label = "' || node || '_' || coverage || '" ]' as line from
  (select family, node, count(*) as coverage, arg_min(side, (read_id, idx, side)) = 0 as is_forward from (select family, first as node, read_id, idx, 0 as side from given where first is not null union all select family, last, read_id, idx, 1 from given where last is not null) group by family, node)
  union all select family, chr(9) || src || ' -> ' || dst || case when etype = 'JF' then ' [ style = dashed ]' else '' end from (select * from inner_edges union all select * from jumps) where etype in ('F', 'JF')""")
def kmer_graph_lines(t):
    return dot.kmer_lines(graph.nodes(t.kept), t.edges)


@query("select family, spacer, coverage, place from (select family, spacer, count(*) as coverage, cast(row_number() over (partition by family order by count(*) desc, spacer) as integer) as place from interior group by 1, 2) where place <= 5")
def most_covered_spacers(t):
    counted = t.interior.groupBy("family", "spacer").agg(F.count("*").alias("coverage"))
    return counted.withColumn("place", F.expr("row_number() over (partition by family order by coverage desc, spacer)")).where("place <= 5")
