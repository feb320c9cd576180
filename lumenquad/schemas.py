"""Explicit schemas of all sources (as DDL), and the fixed registries that rows are checked and named against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Benchmark items; the second form adds the columns of four-way items.
ITEM = "index long, video_path string, question string, answer string, type string"
MCQ_ITEM = "index long, video_path string, question string, answer string, type string, options array<string>, duration string, domain string, sub_category string, task_type string, video_id string, question_id string"
#: Predictions with run metadata flat or under `frames`.
PREDICTION = (
    "index long, video_path string, question string, model_output string, error string, ts string, n_frames_sent int, prompt_tokens long, strategy string, num_frames int, seed int, "
    "frames struct<strategy:string,seed:int,shuffle:boolean,reverse:boolean,hornet_load:string,fps:double,max_frames:int,num_frames:int,saved_dir:string>, frame_indices array<int>, f2c_scales array<double>"
)
PER_QUESTION = (
    "strategy string, nframes int, ablation string, index long, instance_id long, video_path string, question string, gold string, model_output string, extracted string, correct int, frame_indices string, f2c_scales string, error string, pred_file string, duration string, task_type string"
)
SELECTION = "meta struct<sampler:string,num_frames:int,seed:int>, items map<string,struct<indices:array<int>,sizes:array<array<int>>,scales:array<double>>>"
QUAD_METRICS = (
    "Q_Acc double, V_Acc double, Acc double, I_Acc double, F1_yesno_pct double, yesno_Acc_pct double, yes_rate_pct double, confusion struct<TP:long,FP:long,FN:long,TN:long,invalid:long,n_yesno:long>, "
    "config struct<model_name:string,sampling:string,num_frames:int,ablation:string,prompt_template:string,source:string,dataset:string>, _derived boolean"
)
MCQ_METRICS = (
    "Acc double, Acc_pct double, Acc_ci95 array<double>, n long, correct long, invalid long, chance_pct double, majority_baseline_pct double, majority_letter string, gt_distribution map<string,long>, choice_distribution map<string,long>, "
    "by_duration map<string,struct<Acc_pct:double,correct:long,n:long>>, by_task_type map<string,struct<Acc_pct:double,correct:long,n:long>>, config struct<model_name:string,sampling:string,num_frames:int,ablation:string>, _derived boolean"
)
QUESTION_TEMPLATE = "`Instance ID` string, `Question 1` string, `Question 2` string"
WORDS = "word string, side string, dominance double"
ARCHIVE_INDEX = "video_id string, zip string, member string, size long"
RELEVANCE = "key string, pos int, score double, video_index int, embedding array<float>"
CLIPS = "key string, idxs array<int>, s double, s_key double"

#: Samplers in the order of tables, by rank.
SAMPLERS = ["uniform", "random", "hornet", "burst", "f2cfull", "f2c"]
#: Rank of samplers where a tie between best configurations is broken (others rank 9).
TIE_RANK = {"uniform": 0, "random": 1, "hornet": 2, "f2cfull": 3, "f2c": 4}
#: Budgets that tables show.
TABLE_BUDGETS = [1, 4, 8, 16, 24]
#: Taxonomy of the clip number's first field.
CATEGORIES = [*((i, "speed") for i in range(1, 8)), *((i, "magnitude") for i in range(8, 14)), (14, "direction (translational)"), (15, "direction (rotational)")]
#: Suffixes of file names (patterns) that mark an ablation arm.
ABLATIONS = {"shuffled_frames": r"_shuf\d+|_shuffled_frames", "reversed_frames": "_rev|_reversed_frames", "no_video": "_novid|_no_video"}
#: Chance levels in percent.
CHANCE = {"I_Acc": 6.25, "Q_Acc": 25.0, "V_Acc": 25.0, "Acc": 50.0, "mcq4": 25.0}


def datasets(spark: SparkSession, registry: list[tuple[str, int | None, int | None, int | None, list[str]]]) -> DataFrame:
    """A registry of item sets, one row a token that file names use: set, items, instances, videos (null: not known)."""
    rows = spark.createDataFrame(registry, "dataset string, n_items int, n_instances int, n_videos int, tokens array<string>")
    return rows.withColumn("token", F.explode("tokens")).drop("tokens")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category_id int, category string")


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the columns of the schema, in its order and types; missing ones are null, others go."""
    have, schema = {f.name for f in df.schema.fields}, StructType.fromDDL(ddl)
    return df.select(*((F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
