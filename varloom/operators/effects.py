"""What a variant does to the transcripts it touches, and the gravest of it, by built-in functions only.

A transcript's coding exons carry the number of coding bases before them (prefix sums), so that a position becomes an offset
in the coding sequence by one subtraction.  The bases there are replaced, the codons they touch are translated before and after,
and the two pieces of protein tell the effect.  Of all alternates and transcripts of a variant the effect of highest
priority is kept.

Transcripts: contig, gene_name, transcript, strand ('+' or '-'), exons (array of (start, end)), cds_start, cds_end, sequence.
Positions count from 1 and both ends belong to an interval; the coding sequence reads in the transcript's direction.  A null
cds_start means that the transcript codes for nothing.

Defined results: bases that the reference and an alternate have in common at their ends do not count; a null alternate, an
alternate that is no sequence (such as <DEL> or *), and variants outside all transcripts have no effect, so no row.
Transcripts whose coding sequence does not have the length of their coding exons, or is no whole number of codons, are incomplete.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import ascii_only, effect_words
from varloom.schema import ANNOTATIONS, RECORD_KEY

#: Effects from the gravest to the least grave.
PRIORITY = (
    "ExonLoss", "FrameShift", "PrematureStop", "StartLoss", "StopLoss", "SpliceDonor", "SpliceAcceptor", "ComplexSubstitution", "Deletion", "Insertion",
    "Substitution", "AlternateStartCodon", "Silent", "IntronicSpliceSite", "FivePrimeUTR", "ThreePrimeUTR", "Intronic", "IncompleteTranscript", "NoncodingTranscript",
)
# The standard genetic code, with codons in the order of these bases.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Bases of an intron next to an exon: two belong to the splice site itself, and so many more to its surroundings.
SPLICE, NEAR_DONOR, NEAR_ACCEPTOR = 2, 6, 3
#: Positions in a bin of the interval join.
BIN = 1 << 16


def translated(codons: str) -> str:
    """SQL: the amino acids of whole codons; codons with other letters are X.  A single codon, as most are, takes no array."""

    def one(i: str) -> str:
        at = lambda n: f"(locate(substr({codons}, 3 * {i} + {n}, 1), '{BASES}') - 1)"
        return f"if(least({at(1)}, {at(2)}, {at(3)}) >= 0, substr('{AMINO_ACIDS}', 16 * {at(1)} + 4 * {at(2)} + {at(3)} + 1, 1), 'X')"

    return f"case when length({codons}) < 3 then '' when length({codons}) = 3 then {one('0')} else array_join(transform(sequence(0, length({codons}) div 3 - 1), i -> {one('i')}), '') end"


def _common(a: str, b: str) -> str:
    """SQL: how many letters two texts begin with alike; two single letters are compared at once."""
    return f"if(length({a}) = 1 and length({b}) = 1, int({a} = {b}), aggregate(sequence(1, greatest(1, least(length({a}), length({b})))), 0, (n, i) -> if(n = i - 1 and length({a}) >= i and length({b}) >= i and substr({a}, i, 1) = substr({b}, i, 1), i, n)))"


def _opposite(text: str) -> str:
    return f"reverse(translate({text}, 'ACGT', 'TGCA'))"


def prepared(transcripts: DataFrame) -> DataFrame:
    """Transcripts with exons in their direction, the coding parts of these with the coding bases before each, and their span."""
    forward = "strand = '+'"
    exons = f"array_sort(exons, (a, b) -> cast(if({forward}, sign(a.start - b.start), sign(b.start - a.start)) as int))"
    rows = transcripts.withColumn("exons", F.expr(exons)).withColumns({"low": F.array_min(F.transform("exons", lambda e: e["start"])), "high": F.array_max(F.transform("exons", lambda e: e["end"]))})
    parts = "filter(transform(exons, e -> struct(greatest(e.start, cds_start) as start, least(e.end, cds_end) as end)), e -> e.start <= e.end)"
    rows = rows.withColumn("parts", F.expr(f"if(cds_start is null, array(), {parts})"))
    before = "transform(parts, (e, n) -> struct(e.start, e.end, aggregate(slice(parts, 1, n), 0L, (a, x) -> a + x.end - x.start + 1) as before))"
    rows = rows.withColumn("coding", F.expr(before)).withColumn("coding_bases", F.expr("aggregate(parts, 0L, (a, x) -> a + x.end - x.start + 1)"))
    return rows.drop("parts").withColumn("sequence", F.upper("sequence"))


def regions() -> Column:
    """SQL over prepared transcripts: exons and what lies between them, with the coding part of an exon.

    A change inside one region needs no look at the exons.  Where exons overlap there is one region of no kind.
    """
    exon = "struct(cast(e.start as long) as low, cast(e.end as long) as high, true as exon, get(filter(coding, c -> c.start >= e.start and c.end <= e.end), 0) as c)"
    gap = "struct(cast(get(up, i - 1).end + 1 as long) as low, cast(e.start - 1 as long) as high, false as exon, get(filter(coding, c -> false), 0) as c)"
    whole = "struct(cast(low as long) as low, cast(high as long) as high, cast(null as boolean) as exon, get(filter(coding, c -> false), 0) as c)"
    apart = "forall(sequence(0, size(up) - 1), i -> i = 0 or get(up, i).start > get(up, i - 1).end)"
    parts = f"filter(flatten(transform(up, (e, i) -> if(i = 0, array({exon}), array({gap}, {exon})))), r -> r.low <= r.high)"
    return F.expr(f"if({apart}, {parts}, array({whole}))")


def records(calls: DataFrame, bin_size: int = BIN) -> tuple[DataFrame, DataFrame]:
    """(record key, bin) of the records that can touch only one bin of positions, and of others in each of theirs."""
    rows = calls.select(*RECORD_KEY).where("alternates is not null and reference is not null and position is not null")
    # an insertion lies between two bases, of which one may be beside the reference
    rows = rows.withColumns({"_first": F.expr(f"(cast(position as long) - 1) div {bin_size}"), "_last": F.expr(f"(cast(position as long) + length(reference)) div {bin_size}")})
    one = rows.where("_first = _last").select(*RECORD_KEY, F.col("_first").alias("bin"))
    return one, rows.where("_first < _last").select(*RECORD_KEY, F.explode(F.sequence("_first", "_last")).alias("bin"))


def changes(rows: DataFrame) -> DataFrame:
    """(record key, bin, alternate, start, end, before, after): each alternate of each record without common ends.

    An insertion lies between its end and its start, which is one more.
    """
    rows = rows.withColumn("alternate", F.explode(F.split("alternates", ",\\s*"))).withColumns({"ref": F.upper(ascii_only(F.col("reference"))), "alt": F.upper(ascii_only(F.col("alternate")))})
    rows = rows.where("alt rlike '^[ACGTN]+$' and ref rlike '^[ACGTN]+$' and ref <> alt").withColumn("head", F.expr(_common("ref", "alt")))
    rows = rows.withColumns({"ref": F.expr("substr(ref, head + 1)"), "alt": F.expr("substr(alt, head + 1)")})
    rows = rows.withColumn("tail", F.expr(_common("reverse(ref)", "reverse(alt)")))
    start = F.col("position").cast("long") + F.col("head")
    before = F.expr("substr(ref, 1, length(ref) - tail)")
    return rows.select(*RECORD_KEY, "bin", "alternate", start.alias("start"), (start + F.length(before) - 1).alias("end"), before.alias("before"), F.expr("substr(alt, 1, length(alt) - tail)").alias("after"))


def effects(calls: DataFrame, transcripts: DataFrame, bin_size: int = BIN) -> DataFrame:
    """(record key, alternate, gene_name, transcript, effect, notation): of each alternate on each transcript that it touches.

    The join is on contig and bin of positions, so no contig is compared with all its transcripts.
    """
    one, more = (_effects(rows, transcripts, bin_size) for rows in records(calls, bin_size))
    return one.unionByName(more).select(*RECORD_KEY, "alternate", "gene_name", "transcript", "effect", "notation")


def _effects(rows: DataFrame, transcripts: DataFrame, bin_size: int) -> DataFrame:
    """Effects of records that lie in bins.  Records move once, as narrow as they are, to their bins' transcripts."""
    left = changes(rows.repartition("contig", "bin").distinct()).withColumns({"low": F.least("start", "end"), "high": F.greatest("start", "end")})
    right = prepared(transcripts).withColumnRenamed("contig", "t_contig").withColumn("t_bin", F.explode(F.expr(f"sequence(cast(low div {bin_size} as long), cast(high div {bin_size} as long))")))
    right = right.repartition("t_contig", "t_bin").withColumn("up", F.array_sort("exons")).withColumn("of_bin", F.filter(regions(), lambda r: (F.expr(f"t_bin * {bin_size}L") <= r["high"]) & (F.expr(f"(t_bin + 1) * {bin_size}L") > r["low"])))
    right = right.select("t_contig", "t_bin", F.struct("low", "high", "strand", "exons", "coding", "coding_bases", "cds_start", "cds_end", "sequence").alias("t"), "gene_name", "transcript", F.explode("of_bin").alias("g"))
    # a pair that shares several bins or regions meets in the first of them
    first = "greatest(low, t.low)"
    on = (F.col("contig") == F.col("t_contig")) & F.expr(f"bin = t_bin and start <= t.high and `end` >= t.low and t_bin = {first} div {bin_size} and {first} between g.low and g.high")
    return _judged(left.join(right, on)).select(*RECORD_KEY, "bin", "alternate", "gene_name", "transcript", "effect", "notation")


def _judged(rows: DataFrame) -> DataFrame:
    """Adds effect and notation.  An insertion touches an exon only between two of its bases; that is what start > end makes of
    all comparisons below."""
    forward = "t.strand = '+'"
    touched = "e -> e.start <= `end` and e.end >= start"
    # most changes lie inside an exon or between two; only others look at all exons
    rows = rows.withColumn("inside", F.expr("coalesce(g.exon is not null and low >= g.low and high <= g.high, false)"))
    coded = "g.c.start <= `end` and g.c.end >= start"
    rows = rows.withColumns(
        {
            # bases in the transcript's direction
            "a": F.expr(f"if({forward}, before, {_opposite('before')})"), "b": F.expr(f"if({forward}, after, {_opposite('after')})"),
            "exon": F.expr(f"if(inside, int(g.exon), size(filter(t.exons, {touched})))"), "part": F.expr(f"if(inside, if({coded}, array(g.c), null), filter(t.coding, {touched}))"),
            # how far the change lies behind an exon with a donor site, and before one with an acceptor site
            "donor": F.expr(f"if(inside, if({forward}, start - g.low + 1, g.high + 1 - `end`), array_min(filter(transform(slice(t.exons, 1, greatest(size(t.exons) - 1, 0)), e -> if({forward}, start - e.end, e.start - `end`)), d -> d > 0)))"),
            "acceptor": F.expr(f"if(inside, if({forward}, g.high + 1 - `end`, start - g.low + 1), array_min(filter(transform(slice(t.exons, 2, size(t.exons)), e -> if({forward}, e.start - `end`, start - e.end)), d -> d > 0)))"),
        }
    )
    # the first coding base that is changed, or before which an insertion goes
    rows = rows.withColumn("of", F.expr("if(inside, if(part is null, null, g.c), if(size(part) = 1, get(part, 0), null))"))
    rows = rows.withColumn("c", F.expr(f"if({forward}, of.before + start - of.start, of.before + of.end - `end`)"))
    rows = rows.withColumn("c", F.expr("if(of.start <= start and of.end >= `end`, c, null)"))
    rows = rows.withColumns({"k": F.expr("cast(c div 3 as int)"), "r": F.expr("cast(c % 3 as int)"), "shift": F.expr("(length(b) - length(a)) % 3 <> 0")})
    rows = rows.withColumn("old", F.expr("substr(t.sequence, 3 * k + 1, 3 * cast((r + length(a) + 2) div 3 as int))"))
    rows = rows.withColumn("new", F.expr("concat(substr(old, 1, r), b, substr(old, r + length(a) + 1))"))
    rows = rows.withColumns({"p": F.expr(translated("old")), "q": F.expr(f"if(shift, '', {translated('new')})"), "first": F.expr(translated("substr(t.sequence, 3 * k + 1, 3)"))})
    # a change that runs over an exon's end, on the side of a donor or an acceptor site
    low_edge, high_edge = "start < e.start and `end` >= e.start", "start <= e.end and `end` > e.end"
    over_donor = f"exists(slice(t.exons, 1, greatest(size(t.exons) - 1, 0)), e -> if({forward}, {high_edge}, {low_edge}))"
    over_acceptor = f"exists(slice(t.exons, 2, size(t.exons)), e -> if({forward}, {low_edge}, {high_edge}))"
    five = f"if({forward}, least(start, `end`) < t.cds_start, greatest(start, `end`) > t.cds_end)"
    effect = f"""case
      when if(inside, g.exon and start <= g.low and `end` >= g.high, exists(t.exons, e -> start <= e.start and `end` >= e.end)) then 'ExonLoss'
      when not inside and {over_donor} then 'SpliceDonor' when not inside and {over_acceptor} then 'SpliceAcceptor'
      when exon = 0 then case
        when donor <= {SPLICE} then 'SpliceDonor' when acceptor <= {SPLICE} then 'SpliceAcceptor'
        when donor <= {NEAR_DONOR} or acceptor <= {NEAR_ACCEPTOR} then 'IntronicSpliceSite' else 'Intronic' end
      when t.cds_start is null then 'NoncodingTranscript'
      when c is null then case when {five} then if(part is not null and size(part) > 0, 'StartLoss', 'FivePrimeUTR') else if(part is not null and size(part) > 0, 'StopLoss', 'ThreePrimeUTR') end
      when t.coding_bases <> length(t.sequence) or t.coding_bases % 3 <> 0 or t.sequence is null then 'IncompleteTranscript'
      when shift then 'FrameShift'
      when p = q then if(k = 0 and old <> new, 'AlternateStartCodon', 'Silent')
      when k = 0 and left(q, 1) <> left(p, 1) then 'StartLoss'
      when q like '%*%' and p not like '%*%' then 'PrematureStop'
      when p like '%*%' and q not like '%*%' then 'StopLoss'
      when length(p) = 1 and length(q) = 1 then 'Substitution'
      when length(p) = length(q) then 'ComplexSubstitution'
      when length(q) > length(p) and (startswith(q, p) or endswith(q, p)) then 'Insertion'
      when length(p) > length(q) and (startswith(p, q) or endswith(p, q)) then 'Deletion'
      else 'ComplexSubstitution' end"""
    rows = rows.withColumn("effect", F.expr(effect))
    at = "concat('p.', left(p, 1), k + 1)"
    notation = f"""case effect
      when 'FrameShift' then concat('p.', first, k + 1, 'fs')
      when 'Substitution' then concat({at}, q) when 'PrematureStop' then concat('p.', p, k + 1, substring_index(q, '*', 1), '*')
      when 'StartLoss' then if(c is null, 'start-loss', concat({at}, '?')) when 'StopLoss' then if(c is null, 'stop-loss', concat('p.', p, k + 1, q, 'ext'))
      when 'Silent' then 'silent' when 'AlternateStartCodon' then 'alternate-start-codon'
      when 'Insertion' then concat('p.', k + 1, 'ins', if(startswith(q, p), substr(q, length(p) + 1), left(q, length(q) - length(p))))
      when 'Deletion' then concat('p.', if(startswith(p, q), substr(p, length(q) + 1), left(p, length(p) - length(q))), k + 1 + if(startswith(p, q), length(q), 0), 'del')
      when 'ComplexSubstitution' then concat('p.', p, k + 1, q)
      when 'SpliceDonor' then 'splice-donor' when 'SpliceAcceptor' then 'splice-acceptor' when 'IntronicSpliceSite' then 'intronic-splice-site'
      when 'FivePrimeUTR' then "5' UTR" when 'ThreePrimeUTR' then "3' UTR" when 'ExonLoss' then 'exon-loss'
      when 'NoncodingTranscript' then 'non-coding-transcript' when 'IncompleteTranscript' then 'incomplete' else 'intronic' end"""
    return rows.withColumn("notation", F.expr(notation))


def priority(effect: Column) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in PRIORITY]), effect)


def top_effects(calls: DataFrame, transcripts: DataFrame, bin_size: int = BIN) -> DataFrame:
    """(record key, annotation columns) as `annotate.annotations` gives them: each variant's gravest effect.

    Ties go by gene, transcript and notation.
    """
    one, more = (_effects(rows, transcripts, bin_size) for rows in records(calls, bin_size))
    best = F.min(F.struct(priority(F.col("effect")).alias("at"), "gene_name", "transcript", "notation", "effect")).alias("b")
    # what lies in one bin is together already
    rows = one.groupBy("bin", *RECORD_KEY).agg(best).drop("bin").unionByName(more.groupBy(*RECORD_KEY).agg(best))
    values = (F.col("b.gene_name"), F.col("b.transcript"), F.col("b.notation"), effect_words(F.col("b.effect")))
    return rows.select(*RECORD_KEY, *[v.alias(c) for c, v in zip(ANNOTATIONS, values)])
