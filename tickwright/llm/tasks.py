"""Array functions over the rows of a frame, inside tasks."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def flat_map(rows: DataFrame, args: list, keep: list, made: str, function, lists: bool = True) -> DataFrame:
    """Rows made from each row: the columns of keep as they are, then those of made.

    function(*columns) gets the args of a batch as lists (without lists: as Arrow arrays)
    and yields pairs of row numbers and a list of the made columns. Kept columns do not pass through Python
    values, so any type and any null comes back unchanged.
    """
    made_type = StructType.fromDDL(made) if made else StructType()
    schema = StructType([rows.schema[k] for k in keep] + list(made_type))
    kinds = [to_arrow_type(f.dataType) for f in made_type]

    def run(batches):
        for batch in batches:
            values = [batch.column(a).to_pylist() if lists else batch.column(a) for a in args]
            for index, columns in function(*values):
                at = pa.array(index, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).take(at) for k in keep]
                    + [c if isinstance(c, pa.Array) else pa.array(c, kind, from_pandas=True)
                       for c, kind in zip(columns, kinds)], names=schema.names)

    return rows.select(*dict.fromkeys([*args, *keep])).mapInArrow(run, schema)
