"""The corpus pipeline: documents that are identified, deduplicated, decontaminated, mixed and sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet in the shared work folder and the next stage reads that. All stages but the
last return the columns of documents, the last one adds shard and slot.

For all stages: whole texts are judged, however long; a null or empty text is what the
stage's operator says of it; columns beyond doc_id, text, lang and source are carried as
they are, whatever their names; an empty table stays empty. Decisions are by doc_id: rows
that share one are kept or dropped together, and rows without one are dropped by the
first stage only, if their text is rejected.
"""

from pyspark.sql import functions as F

from tickwright.llm import jaccard, language, mixing, sharding, winnowing
from tickwright.llm.tables import written

SHARDS = 40


def identify_language(spark, docs, sf_dir):
    """Rejected documents go (null, empty and letterless texts with them); the others get the predicted language.

    Each row is judged by itself, so repeated rows fare alike. Of equally near centroids
    the first in order of the language's name counts. The result is written here, as it
    is made in Python in small batches.
    """
    model = language.fit(docs.select("doc_id", "text", "lang"))
    names = ("__lang", "__score", "__rejected")      # no column of documents has such a name
    named = language.identify(docs, model, names=names).filter("NOT __rejected")
    return written(named.withColumn("lang", F.col("__lang")).select(*docs.columns), "identified")


def drop_near_copies(spark, docs, sf_dir):
    """Of each group of linked documents the one with the smallest id stays.

    Texts without words are linked with nothing and stay. Rows that share an id are one
    document and stay or go together; rows without an id stay.
    """
    members = jaccard.jaccard_components(docs)
    going = members.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(going, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark, docs, sf_dir):
    """Documents of which benchmark items make up 5 % of the words or more go.

    Texts without words stay, as do rows without an id. Of rows that share an id all go
    if one is contaminated.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged, _ = winnowing.decontaminate(docs, benchmark)
    going = judged.filter("contaminated").select("doc_id").distinct()
    return docs.join(going, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Each document as often as the mix takes it; one without words is left out.

    A null source is a source. Repeated rows are repeated alike. Documents that tie in
    the shuffled order are put in order by id.
    """
    return mixing.mixed_documents(docs)


def assign_shards(spark, docs, sf_dir):
    """Every document with its shard and its place there, which replace columns of those names.

    Rows with one id share a shard and have places of their own; a row without an id goes
    by its text, a null text counts as empty.
    """
    own = [c for c in docs.columns if c in ("size", "text_crc32", "grown_shard")]
    kept = docs.withColumnsRenamed({c: f"__own_{c}" for c in own})
    done = sharding.shard_documents(kept, SHARDS).drop("size", "text_crc32", "grown_shard")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    return done.withColumnsRenamed({f"__own_{c}": c for c in own}).select(*names, "shard", "slot")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The first stage is a fitted classifier, which SQL cannot state; tests compare with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
