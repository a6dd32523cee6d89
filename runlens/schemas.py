"""Record layouts of the files that benchmark runs leave behind."""

from pyspark.sql import types as T

_STR, _INT, _NUM = T.StringType(), T.LongType(), T.DoubleType()


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RUN = _record(
    timestamp=_STR,
    prediction_file=_STR,
    dataset=_STR,
    num_instances=_INT,
    generation_score=_NUM,
    evaluation_score=_NUM,
    evaluation_status=_STR,
    generation_time=_NUM,
    evaluation_time=_NUM,
    model=_STR,
    backend=_STR,
    notes=_STR,
    evaluation_timestamp=_STR,
)

PREDICTION = _record(instance_id=_STR, model=_STR, prediction=_STR, error=_STR)

SUBMISSION = _record(instance_id=_STR, model_name_or_path=_STR, model_patch=_STR)

REPORT = _record(resolved_instances=_INT, total_instances=_INT)

INSTANCE = _record(
    instance_id=_STR,
    repo=_STR,
    version=_STR,
    base_commit=_STR,
    problem_statement=_STR,
    hints_text=_STR,
    created_at=_STR,
    test_patch=_STR,
    environment_setup_commit=_STR,
)

RAW_RESULT = _record(
    instance_id=_STR,
    timestamp=_STR,
    claude_output=T.StructType(
        [
            T.StructField("success", T.BooleanType()),
            T.StructField("stdout", _STR),
            T.StructField("stderr", _STR),
            T.StructField("returncode", T.IntegerType()),
        ]
    ),
    extracted_patch=_STR,
)
