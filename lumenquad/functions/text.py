"""Names, prompts and messages: parsing of file and clip names, question texts, redaction, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ABLATIONS

#: Fixed value: sampler, budget and variant at the end of a prediction file's name.
CELL = r"_(uniform|random|hornet|burst|f2cfull|f2c)(\d+)((?:_full|_noencoder)?(?:_pool\d+)?)$"
#: What a question of each type ends in.
SUFFIX = {"yes_no": " Please output Yes or No.", "multiple_choice": " Please output A or B.", "multiple_choice_4": " Please output A, B, C, or D."}
#: Text around a four-way question.
CHOICE_PREFIX = "Select the best answer to the following multiple-choice question based on the video. Respond with only the letter (A, B, C, or D) of the correct option."
CHOICE_SUFFIX = "The best answer is:"


def instance_id(index: Column) -> Column:
    """Floor division, also below nought."""
    return F.floor(index / 4).cast("long")


def role(index: Column) -> Column:
    return F.pmod(index, F.lit(4)).cast("int")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Base name without its last extension (a leading dot is none)."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def category_id(path: Column) -> Column:
    """First field of a clip name like 15_05_1.mp4, null for other names."""
    # Fixed value: the form of such names.
    return F.nullif(F.regexp_extract(base_name(path), r"(\d+)_\d+_\d+\.mp4$", 1), F.lit("")).cast("int")


def ablation(name: Column) -> Column:
    """Arm that a file's stem ends in; none otherwise."""
    out = F.lit("none")
    for arm, suffix in ABLATIONS.items():
        out = F.when(F.regexp_like(name, F.lit(f"(?:{suffix})$")), arm).otherwise(out)
    return out


def without_ablation(name: Column) -> Column:
    return F.regexp_replace(name, f"(?:{'|'.join(ABLATIONS.values())})$", "")


def cell_of(file_name: Column) -> Column:
    """struct(sampler, num_frames, ablation, variant) of a prediction file; null if the name has no cell.

    The arm without video has neither sampler nor budget: none and 0. Each pattern runs once a name: the struct is made
    inside a lambda, which keeps its parts from being inlined into every use.
    """
    name = F.regexp_replace(file_name, r"\.json$", "")

    def made(parts: Column) -> Column:
        arm, cell = parts["arm"], F.split(parts["cell"], " ")
        found = F.size(cell) == 3
        return F.when(
            found | (arm == "no_video"),
            F.struct(
                F.when(found, cell[0]).otherwise("none").alias("sampler"),
                F.when(found, F.try_element_at(cell, F.lit(2))).otherwise("0").cast("int").alias("num_frames"),
                arm.alias("ablation"),
                F.when(found, F.ltrim(F.try_element_at(cell, F.lit(3)), F.lit("_"))).otherwise("").alias("variant"),
            ),
        )

    cell = F.regexp_replace(F.nullif(F.regexp_substr(without_ablation(name), F.lit(CELL)), F.lit("")), CELL, "$1 $2 $3")
    parts = F.struct(ablation(name).alias("arm"), F.coalesce(cell, F.lit("")).alias("cell"))
    return F.try_element_at(F.transform(F.array(parts), made), F.lit(1))


def readable_prediction(file_name: Column) -> Column:
    """Whether a file holds predictions of a whole cell, by its name."""
    return ~(F.startswith(file_name, F.lit("_")) | F.contains(file_name, F.lit("_metrics")) | F.contains(file_name, F.lit("_smoke_")) | F.endswith(file_name, F.lit("_smoke.json")))


def cell_tag(sampler: Column, num_frames: Column, arm: Column) -> Column:
    """Name of a cell: sampler and budget with the arm behind, or the arm alone where there's no budget."""
    return F.when(num_frames == 0, arm).otherwise(F.concat(sampler, num_frames.cast("string"), F.when(arm == "none", "").otherwise(F.concat(F.lit("_"), arm))))


def output_name(subject: Column, dataset: Column, sampler: Column, num_frames: Column, arm: Column, seed: Column) -> Column:
    """Conventional name of a prediction file."""
    short = F.when(arm == "no_video", "_novid").when(arm == "reversed_frames", "_rev").when(arm == "shuffled_frames", F.concat(F.lit("_shuf"), seed.cast("string"))).otherwise("")
    return F.concat(subject, F.lit("_"), dataset, F.lit("_"), sampler, F.when(num_frames > 0, num_frames.cast("string")).otherwise(""), short, F.lit(".json"))


def question_text(question: Column, kind: Column) -> Column:
    out = question
    for k, suffix in SUFFIX.items():
        out = F.when(kind == k, F.concat(question, F.lit(suffix))).otherwise(out)
    return out


def choice_text(question: Column, options: Column) -> Column:
    """Whole text of a four-way question: options get their letter unless they bring one."""
    lines = F.transform(options, lambda o, i: F.when(F.regexp_like(o, F.lit(r"^[A-D][\.\)]")), o).otherwise(F.concat(F.substring(F.lit("ABCD"), i + 1, F.lit(1)), F.lit(". "), o)))
    return F.concat_ws("\n", F.lit(CHOICE_PREFIX), F.lit(""), question, lines, F.lit(""), F.lit(CHOICE_SUFFIX))


def prompt(question: Column, kind: Column, options: Column) -> Column:
    return F.when(kind == "mcq4", choice_text(question, options)).otherwise(question_text(question, kind))


# What is hidden in messages, and marks of errors that a retry can't mend or that tell a spent quota.
SECRET = r"(?U)(sk-[A-Za-z0-9_\-]{8,}|hf_[A-Za-z0-9]{8,}|Bearer\s+\S+)"
FATAL = ["insufficient_quota", "credit_balance_exhausted", "invalid_api_key", "account_deactivated", "model_not_found", "NotFoundError", "Error code: 404"]
QUOTA = ["429", "resource_exhausted", "resourceexhausted", "quota", "rate limit", "ratelimit"]


def redact(text: Column) -> Column:
    """Keys and bearer tokens hidden."""
    return F.regexp_replace(text, SECRET, "<REDACTED>")


def retry_delay(message: Column) -> Column:
    """Seconds a message asks to wait for, null if it doesn't."""
    # Fixed value: how services word it.
    return F.nullif(F.regexp_extract(message, r"(?iU)retry[_-]?delay['\"]?\s*[:=]\s*['\"]?(\d+(?:\.\d+)?)s", 1), F.lit("")).cast("double")


def error_class(message: Column) -> Column:
    """fatal, quota, other, or none for a blank message."""
    return F.when(F.coalesce(F.trim(message), F.lit("")) == "", "none").when(has_any(message, FATAL, False), "fatal").when(has_any(message, QUOTA), "quota").otherwise("other")


def has_any(text: Column, words: list[str], any_case: bool = True) -> Column:
    """Whether a text holds one of the words."""
    text = F.lower(text) if any_case else text
    return F.exists(F.array(*(F.lit(w.lower() if any_case else w) for w in words)), lambda w: F.contains(text, w))


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def token_prefixes(name: Column) -> Column:
    """A name's beginnings that end at an underscore or with it: all that a token it starts with can be."""
    words = F.split(name, "_")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), "_"))
