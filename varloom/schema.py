"""Columns of the call table and of the small tables around it."""
from __future__ import annotations

from pyspark.sql import types as T

CORE = ("vcf_id", "sample_name", "contig", "position", "id", "reference", "alternates", "filters", "quality")
ANNOTATIONS = ("annotations:gene_name", "annotations:transcript", "annotations:effect_notation", "annotations:effect_type")
STARRED = "annotations:starred"

# INFO and FORMAT fields that the call table keeps.
INFO = (
    "AA AC AF AN BQ CIGAR DB DP H2 H3 MQ MQ0 NS SB SOMATIC VALIDATED 1000G IMPRECISE NOVEL END SVTYPE SVLEN CIPOS CIEND "
    "MEINFO METRANS DGVID DBVARID DBRIP MATEID PARID EVENT CILEN DPADJ CN CNADJ CICN CICNADJ STR CIPOS95 EVTYPE PSUP PRIN "
    "SRSUP SUP QSS QSS_NT SGT TQSS TQSS_NT NT SS SSC GPV SPV NDP NAC DDP DAC ABQ AMQ AGQ VAF DPR"
).split()
SAMPLE = (
    "GT DP FT GL GLE PL GP GQ HQ PS PQ EC MQ CN CNQ CNL NQ HAP AHAP PE SR SUP FDP SDP SUBDP AU CU GU TU RD AD FREQ DP4 IGT "
    "BCOUNT JGQ VAQ AMQ FA ABQ AGQ"
).split()

INFO_COLUMNS = [f"info:{x}" for x in INFO]
SAMPLE_COLUMNS = [f"sample:{x}" for x in SAMPLE]
#: Columns that may be empty for a whole run; the star is kept apart.
EXTANT_CANDIDATES = [*INFO_COLUMNS, *SAMPLE_COLUMNS, *ANNOTATIONS]

#: A record, a sample's call, and their keys.
RECORD_KEY = ("contig", "position", "reference", "alternates")
CALL_KEY = (*RECORD_KEY, "sample_name")
#: A call's key as one text, where a table has it.
CALL_ID = "call_id"
#: Parts of a key that may be missing in a file (`.`), and then are equal to each other.
NULLABLE = ("reference", "alternates")

_TYPES = {"vcf_id": T.LongType(), "position": T.IntegerType(), STARRED: T.BooleanType()}
CALLS = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in (*CORE, *ANNOTATIONS, STARRED, *INFO_COLUMNS, *SAMPLE_COLUMNS)])

RUNS = "id long, created_at timestamp, tumor_bam_id long, normal_bam_id long, project_id long, caller_name string, notes string, uri string, vcf_header string, vcf_release int, extant_columns array<string>, genotype_count long"
PROJECTS = "id long, name string, notes string"
BAMS = "id long, project_id long, name string, normal boolean, notes string, tissues string, resection_date string, uri string"
COMMENTS = "id long, vcf_id long, sample_name string, contig string, position int, reference string, alternates string, comment_text string, user_id long, created timestamp, last_modified timestamp"
TASKS = "id long, vcf_id long, type string, task_id string, state string"
STARS = "vcf_id long, contig string, position int, reference string, alternates string, sample_name string, starred boolean, at timestamp, seq long"
USERS = "id long, username string, email string"
