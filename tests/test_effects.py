"""Predicted effects against a plain implementation on made-up genes, and single cases by hand."""
import random

import pytest

from varloom.functions import cell
from varloom.operators.annotate import annotated
from varloom.operators.effects import AMINO_ACIDS, BASES, effects, top_effects
from varloom.schema import ANNOTATIONS
from varloom.sources.transcripts import read_sequences, read_transcripts

TRANSCRIPT = "contig string, gene_name string, transcript string, strand string, exons array<struct<start: long, end: long>>, cds_start long, cds_end long, sequence string"
VARIANT = "contig string, position int, reference string, alternates string"
#: Coding bases 101..115 and 131..148 of exons 91..115, 131..160: M A R N D C E Q G H *
CDS = "ATGGCTCGTAATGATTGTGAACAAGGTCATTAA"
EXONS = [(91, 115), (131, 160)]


def opposite(text):
    return text[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def genes(spark):
    rows = [
        ("1", "F", "F1", "+", EXONS, 101, 148, CDS),
        ("2", "R", "R1", "-", [(1000 - b, 1000 - a) for a, b in EXONS], 1000 - 148, 1000 - 101, CDS),
        ("3", "N", "N1", "+", EXONS, None, None, None),
        ("4", "I", "I1", "+", EXONS, 101, 148, CDS[:-1]),
        ("1", "F", "F0", "+", [(91, 160)], None, None, None),
    ]
    return spark.createDataFrame(rows, TRANSCRIPT)


CASES = [
    (104, "G", "A", "Substitution", "p.A2T"), (106, "T", "C", "Silent", "silent"), (101, "A", "G", "StartLoss", "p.M1?"), (113, "G", "T", "Substitution", "p.D5Y"),
    (131, "T", "A", "Substitution", "p.C6S"), (133, "T", "A", "PrematureStop", "p.C6*"), (146, "T", "C", "StopLoss", "p.*11Qext"), (104, "GC", "G", "FrameShift", "p.A2fs"),
    (104, "GCTC", "G", "ComplexSubstitution", "p.AR2G"), (103, "GGCT", "G", "Deletion", "p.A2del"), (106, "T", "TGGG", "Insertion", "p.3insG"), (103, "G", "GAAAAAA", "Insertion", "p.2insKK"),
    (116, "G", "C", "SpliceDonor", "splice-donor"), (117, "G", "C", "SpliceDonor", "splice-donor"), (118, "G", "C", "IntronicSpliceSite", "intronic-splice-site"), (123, "G", "C", "Intronic", "intronic"),
    (130, "G", "C", "SpliceAcceptor", "splice-acceptor"), (129, "G", "C", "SpliceAcceptor", "splice-acceptor"), (128, "G", "C", "IntronicSpliceSite", "intronic-splice-site"), (95, "G", "C", "FivePrimeUTR", "5' UTR"),
    (155, "G", "C", "ThreePrimeUTR", "3' UTR"), (114, "ATGG", "A", "SpliceDonor", "splice-donor"), (128, "GGGT", "G", "SpliceAcceptor", "splice-acceptor"), (120, "G" * 45, "G", "ExonLoss", "exon-loss"),
    (99, "GGAT", "G", "StartLoss", "start-loss"), (100, "G", "GCC", "FivePrimeUTR", "5' UTR"), (148, "A", "AC", "ThreePrimeUTR", "3' UTR"), (106, "TC", "TG", "Substitution", "p.R3G"), (106, "T", "TTAA", "PrematureStop", "p.3*"),
]


@pytest.mark.parametrize("contig, strand", [("1", "+"), ("2", "-")])
def test_effects_by_hand(spark, genes, contig, strand):
    """The same cases on a gene and on its mirror image."""
    rows, want = [], {}
    for at, ref, alt, effect, notation in CASES:
        if strand == "-":
            # where lengths differ, without the first base that both have, and with another at the other end
            head = len(ref) != len(alt)
            at, ref, alt = 1000 - (at + len(ref) - 1) - head, "N" * head + opposite(ref[head:]), "N" * head + opposite(alt[head:])
        rows.append((contig, at, ref, alt))
        want[at, ref, alt] = (effect, notation)
    got = effects(spark.createDataFrame(rows, VARIANT), genes.where("transcript in ('F1', 'R1')")).collect()
    assert {(r["position"], r["reference"], r["alternates"]): (r["effect"], r["notation"]) for r in got} == want


def test_gravest_effect_of_alternates_and_transcripts(spark, genes):
    rows = [("1", 106, "T", "C,A"), ("1", 104, "G", "A,<DEL>"), ("1", 104, "G", None), ("1", 104, "G", "*"), ("1", 123, "A", "C"), ("3", 104, "G", "A"), ("4", 104, "G", "A"), ("1", 500, "A", "C"), ("9", 104, "A", "C"), ("1", 104, "g", "a")]
    got = {(r["contig"], r["position"], r["reference"], r["alternates"]): tuple(r[c] for c in ANNOTATIONS) for r in top_effects(spark.createDataFrame(rows, VARIANT), genes, 64).collect()}
    assert got == {
        ("1", 106, "T", "C,A"): ("F", "F1", "silent", "Silent"),
        ("1", 104, "G", "A,<DEL>"): ("F", "F1", "p.A2T", "Substitution"),
        ("1", 104, "g", "a"): ("F", "F1", "p.A2T", "Substitution"),
        ("1", 123, "A", "C"): ("F", "F1", "intronic", "Intronic"),
        ("3", 104, "G", "A"): ("N", "N1", "non-coding-transcript", "Noncoding Transcript"),
        ("4", 104, "G", "A"): ("I", "I1", "incomplete", "Incomplete Transcript"),
    }


def protein(cds):
    return "".join(AMINO_ACIDS[16 * BASES.index(cds[i]) + 4 * BASES.index(cds[i + 1]) + BASES.index(cds[i + 2])] for i in range(0, len(cds) - 2, 3))


def test_coding_changes_against_whole_proteins(spark):
    """Exchanges, deletions and insertions inside the coding parts of random genes: the whole protein is translated again."""
    r, genes, rows, want = random.Random(5), [], [], {}
    for g in range(12):
        lengths, at, exons = [r.randint(12, 40) for _ in range(r.randint(1, 4))], 50, []
        lengths[-1] += -sum(lengths) % 3
        for n in lengths:
            exons.append((at, at + n - 1))
            at += n + r.randint(20, 90)
        cds = "ATG" + "".join(r.choice("ACG") + r.choice("ACGT") + r.choice("ACGT") for _ in range(sum(lengths) // 3 - 2)) + "TAA"
        strand = r.choice("+-")
        genes.append((str(g), f"G{g}", f"T{g}", strand, r.sample(exons, len(exons)), exons[0][0], exons[-1][1], cds))
        places = [p for a, b in exons for p in range(a, b + 1)]
        forward = cds if strand == "+" else opposite(cds)
        for _ in range(40):
            i = r.randrange(1, len(places) - 8)
            kind, n = r.choice("XDI"), r.choice([1, 2, 3, 6])
            take = n if kind == "D" else 1
            if places[i + take] - places[i] != take:
                continue  # the change would leave its exon
            before = forward[i : i + take + (kind == "D")]
            after = {"X": r.choice([b for b in "ACGT" if b != before[0]]), "D": before[0], "I": before + "".join(r.choice("ACGT") for _ in range(n))}[kind]
            new = forward[:i] + after + forward[i + len(before) :]
            old_p, new_p = protein(cds), protein(new if strand == "+" else opposite(new))
            shift = (len(new) - len(forward)) % 3 != 0
            rows.append((str(g), places[i], before, after))
            want[str(g), places[i], before, after] = "FrameShift" if shift else "same" if old_p == new_p else "stop" if "*" in new_p[:-1] and len(new_p.split("*")[0]) < len(old_p) - 1 else "changed"
    got = {(x["contig"], x["position"], x["reference"], x["alternates"]): x["effect"] for x in effects(spark.createDataFrame(rows, VARIANT), spark.createDataFrame(genes, TRANSCRIPT), 32).collect()}
    kinds = {"FrameShift": {"FrameShift"}, "same": {"Silent", "AlternateStartCodon"}, "stop": {"PrematureStop", "StartLoss"}, "changed": {"Substitution", "ComplexSubstitution", "Insertion", "Deletion", "StartLoss", "StopLoss"}}
    assert len(want) > 200 and set(got) == set(want)
    assert [(k, got[k], w) for k, w in want.items() if got[k] not in kinds[w]] == []


def test_records_move_once(spark, genes):
    """Records are dealt to the bins of transcripts and stay there; only those in several bins are brought together again."""
    rows = [("1", at, ref, alt) for at, ref, alt, _, _ in CASES]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = top_effects(spark.createDataFrame(rows, VARIANT), genes, 32)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ENSURE_REQUIREMENTS") == 1 and plan.count("REPARTITION_BY_COL") == 4
        want = sorted(map(str, found.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for size in (7, 1 << 16):
        assert sorted(map(str, top_effects(spark.createDataFrame(rows, VARIANT), genes, size).collect())) == want
    # exons that overlap or adjoin
    odd = spark.createDataFrame([("1", "O", "O1", "+", [(91, 120), (110, 140)], None, None, None), ("1", "A", "A1", "+", [(91, 100), (101, 140)], None, None, None)], TRANSCRIPT)
    got = effects(spark.createDataFrame([("1", 115, "A", "C"), ("1", 101, "A", "C"), ("1", 140, "A", "C")], VARIANT), odd, 16).collect()
    assert sorted((r["position"], r["transcript"], r["effect"]) for r in got) == [(p, n, "NoncodingTranscript") for p in (101, 115, 140) for n in ("A1", "O1")]


def test_annotations_of_calls(spark, genes):
    calls = spark.createDataFrame([("1", 104, "G", "A"), ("1", 9999, "G", "A")], VARIANT).selectExpr("*", *[f"cast(null as string) as `{c}`" for c in ANNOTATIONS])
    rows = {r["position"]: r for r in annotated(calls, top_effects(calls, genes)).select("position", *[cell(c) for c in ANNOTATIONS]).collect()}
    assert rows[104]["annotations:effect_notation"] == "p.A2T" and rows[9999]["annotations:gene_name"] is None


def test_transcripts_from_files(spark, tmp_path):
    gtf, cds = tmp_path / "g.gtf", tmp_path / "c.fa"
    more = 'gene_id "E1"; gene_version "3"; transcript_id "{t}"; {g}tag "x";'
    line = lambda f, a, b, t, g='gene_name "F"; ', strand="+": "\t".join(["1", "db", f, str(a), str(b), ".", strand, ".", more.format(t=t, g=g)])
    gtf.write_text("\n".join([
        "#!genome", "", "short\tline", line("exon", 91, 115, "F1"), line("exon", 131, 160, "F1"), line("CDS", 101, 115, "F1"), line("CDS", 131, 145, "F1"), line("stop_codon", 146, 148, "F1"),
        line("gene", 1, 999, "F1"), line("exon", 5, 3, "F1"), line("exon", 91, 160, "N.A", g=""), line("exon", 200, 208, "L1", strand="-"), line("CDS", 200, 208, "L1", strand="-"),
    ]) + "\n")
    cds.write_text(f">F1.12 cds chromosome:1\r\n{CDS[:10]}\r\n{CDS[10:].lower()}\r\n>N.A.2\nACG\n>other\n\n>L1\nATGGCT\nTAA")
    rows = {r["transcript"]: r for r in read_transcripts(spark, f"file://{gtf}", f"file://{cds}").collect()}
    assert set(rows) == {"F1", "N.A", "L1"}
    f = rows["F1"]
    assert (f["gene_name"], [tuple(e) for e in f["exons"]], f["cds_start"], f["cds_end"], f["sequence"]) == ("F", EXONS, 101, 148, CDS)
    assert (rows["N.A"]["gene_name"], rows["N.A"]["cds_start"], rows["N.A"]["sequence"]) == ("E1", None, "ACG") and rows["L1"]["strand"] == "-" and rows["L1"]["sequence"] == "ATGGCTTAA"
    assert {r["transcript"] for r in read_sequences(spark, f"file://{cds}", True).collect()} == {"F1.12", "N.A.2", "other", "L1"}
    got = effects(spark.createDataFrame([("1", 104, "G", "A")], VARIANT), read_transcripts(spark, f"file://{gtf}", f"file://{cds}")).collect()
    assert {(r["transcript"], r["notation"]) for r in got} == {("F1", "p.A2T"), ("N.A", "non-coding-transcript")}
