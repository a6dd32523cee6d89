"""Changed files between snapshots, patch validation and patch applicability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.diffs import lines_of, old_side, parse_patch, patch_problem, with_value
from runlens.functions.text import response_changes

# --- fixed values -----------------------------------------------------------
APPLIES = "Patch can be applied cleanly"
DOES_NOT_APPLY = "Patch application failed: "
# ----------------------------------------------------------------------------

_KEY = ("snapshot_id", "path")
# Lines of a file that are compared in one place.
BLOCK_LINES = 256


def extracted_changes(responses: DataFrame, text: str = "text") -> DataFrame:
    """One row per change found in a response, diff blocks first, counted from 0."""
    kept = [c for c in responses.columns if c != text]
    return responses.select(
        *kept, F.posexplode(response_changes(F.col(text))).alias("ordinal", "_change")
    ).select(*kept, "ordinal", "_change.*")


def _differs() -> Column:
    """Whether the digests ``_old`` and ``_new`` differ, a missing file being empty."""
    of_nothing = F.sha2(F.lit(""), 256)
    return F.coalesce("_old", of_nothing) != F.coalesce("_new", of_nothing)


def _change() -> Column:
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
    return kind.otherwise("modified").alias("change")


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose content differs between two snapshots (snapshot_id, path, content).

    A file missing on one side counts as empty, so an empty file equals none. Only
    digests of the contents are joined, not the contents.
    """
    digest = F.sha2("content", 256)
    old = before.select(*_KEY, digest.alias("_old"))
    new = after.select(*_KEY, digest.alias("_new"))
    return old.join(new, list(_KEY), "full").where(_differs()).select(*_KEY, _change())


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed paths with both contents, empty where a file is missing."""
    text = lambda frame, name: frame.select(*_KEY, F.col("content").alias(name))
    joined = (
        changed_paths(before, after)
        .join(text(before, "before"), list(_KEY), "left")
        .join(text(after, "after"), list(_KEY), "left")
    )
    return joined.na.fill("", ["before", "after"])


def change_set(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed files with the numbers of lines added and removed.

    Lines are compared with their ends, as a multiset per file, by 64-bit hashes. Each
    side is read once and gives a digest and the hashes of its lines per file; contents
    never leave their scan. Hashes are counted for the files whose digests differ only.
    """
    lines = F.filter(F.split("content", r"(?<=\n)"), lambda line: line != "")
    hashes = F.transform(lines, lambda line: F.xxhash64(line))

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(*_KEY, F.sha2("content", 256).alias(f"_{name}"), hashes.alias(f"_{name}_lines"))

    def signed(name: str, sign: int) -> Column:
        known = F.coalesce(f"_{name}_lines", F.array().cast("array<bigint>"))
        return F.transform(known, lambda line: F.struct(line.alias("line"), F.lit(sign).alias("sign")))

    both = side(before, "old").join(side(after, "new"), list(_KEY), "full").where(_differs())
    exploded = both.select(*_KEY, _change(), F.inline(F.concat(signed("old", -1), signed("new", 1))))
    net = exploded.groupBy(*_KEY, "change", "line").agg(F.sum("sign").alias("_net"))
    plus = F.when(F.col("_net") > 0, F.col("_net")).otherwise(0)
    minus = F.when(F.col("_net") < 0, -F.col("_net")).otherwise(0)
    return net.groupBy(*_KEY, "change").agg(
        F.sum(plus).alias("lines_added"), F.sum(minus).alias("lines_removed")
    )


def validate_patches(patches: DataFrame, patch: str = "patch") -> DataFrame:
    """Add ``valid`` and ``problem``, the reason why a patch is not well formed."""
    return (
        patches.withColumn("_parsed", parse_patch(patch))
        .withColumn("problem", patch_problem(F.col(patch), F.col("_parsed")))
        .withColumn("valid", F.col("problem").isNull())
        .select(*patches.columns, "valid", "problem")
    )


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.xxhash64(line))


def _file_blocks(files: DataFrame) -> DataFrame:
    """Hashes of the lines of each file, ``BLOCK_LINES`` lines a row; an empty file has one empty block."""
    hashed = files.select(*_KEY, _hashes(lines_of("coalesce(content, '')")).alias("_lines"), F.col("content").isNotNull().alias("_present"))
    last = F.floor((F.greatest(F.size("_lines"), F.lit(1)) - 1) / BLOCK_LINES)
    blocks = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda b: F.slice("_lines", (b * BLOCK_LINES + 1).cast("int"), F.lit(BLOCK_LINES)))
    return hashed.select(*_KEY, "_present", F.posexplode(blocks).alias("_block", "_known"))


def _pieces(hunk: Column) -> Column:
    """A hunk's old lines, cut where blocks of file lines end."""
    lines = hunk.getField("lines")
    start = F.greatest(hunk.getField("start"), F.lit(1)) - 1
    end = start + F.size(lines) - 1

    def piece(block: Column) -> Column:
        first = F.greatest(block * BLOCK_LINES, start)
        size = F.least((block + 1) * BLOCK_LINES - 1, end) - first + 1
        return F.struct(
            hunk.getField("path").alias("path"),
            block.cast("int").alias("_block"),
            (first - block * BLOCK_LINES).cast("int").alias("_offset"),
            F.slice(lines, (first - start + 1).cast("int"), size.cast("int")).alias("_wanted"),
        )

    blocks = F.sequence(F.floor(start / BLOCK_LINES), F.floor(F.greatest(end, start) / BLOCK_LINES))
    return F.transform(F.filter(blocks, lambda _: F.size(lines) > 0), piece)


def patches_applying(patches: DataFrame, files: DataFrame) -> DataFrame:
    """Whether each patch fits its snapshot: every hunk's old lines stand where it says.

    ``patches`` has patch_id, snapshot_id and patch; ``files`` is the snapshot. Hunks
    are matched at their stated position only. A file that a patch creates must not
    exist yet. Lines are compared by 64-bit hashes. Hunks and files are cut into blocks
    of lines that meet by snapshot, path and block, so that a file which many patches touch is
    read once and its blocks go to different tasks; contents and patches are not shuffled.
    """
    parsed = patches.select("patch_id", "snapshot_id", "patch").withColumn(
        "_parsed", parse_patch("patch")
    )
    hunks = with_value(
        lines_of("coalesce(patch, '')"),
        lambda lines: F.transform(
            "_parsed.hunks",
            lambda hunk: F.struct(
                hunk.getField("path").alias("path"),
                hunk.getField("start").alias("start"),
                _hashes(old_side(lines, hunk)).alias("lines"),
            ),
        ),
    )
    checked = parsed.select(
        "patch_id",
        "snapshot_id",
        patch_problem(F.col("patch"), F.col("_parsed")).alias("_problem"),
        F.col("_parsed.created").alias("_created"),
        hunks.alias("_hunks"),
    )
    paths = F.array_distinct(F.transform("_hunks", lambda hunk: hunk.getField("path")))
    # One piece without lines per path asks whether the file is there.
    asked = F.transform(
        paths,
        lambda path: F.struct(
            path.alias("path"), F.lit(0).alias("_block"), F.lit(0).alias("_offset"), F.array().cast("array<bigint>").alias("_wanted")
        ),
    )
    pieces = F.concat(asked, F.flatten(F.transform("_hunks", _pieces)))
    # Outer, as a patch without hunks must keep its row.
    targets = checked.select("patch_id", "snapshot_id", "_problem", "_created", F.inline_outer(pieces))
    targets = targets.select(
        "patch_id", *_KEY, "_problem", F.array_contains("_created", F.col("path")).alias("_creates"), "_block", "_offset", "_wanted"
    )
    met = targets.join(_file_blocks(files), [*_KEY, "_block"], "left")
    present, asks = F.coalesce("_present", F.lit(False)), F.size("_wanted") == 0
    stands = F.slice("_known", F.col("_offset") + 1, F.size("_wanted")) == F.col("_wanted")
    reason = (
        F.when(F.col("path").isNull(), None)
        .when(asks & F.col("_creates") & present, "file exists already")
        .when(asks & ~F.col("_creates") & ~present, "file does not exist")
        .when(~asks & ~F.col("_creates") & ~F.coalesce(stands, F.lit(False)), "hunk does not fit")
    )
    # Of several reasons the least is told, so a missing file comes before its hunks.
    judged = met.withColumn("_reason", F.coalesce("_problem", reason))
    return judged.groupBy("patch_id").agg(F.min("_reason").alias("_why")).select(
        "patch_id",
        F.col("_why").isNull().alias("applies"),
        F.coalesce(F.concat(F.lit(DOES_NOT_APPLY), "_why"), F.lit(APPLIES)).alias("message"),
    )
