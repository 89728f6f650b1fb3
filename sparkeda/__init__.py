"""sparkeda: exploratory data analysis operators expressed as Spark jobs.

Every operator takes and returns DataFrames (or small driver-side results
such as fitted parameters); the heavy work runs on executors.
"""

from sparkeda.session import get_spark, checkpoint_dir, read_table
from sparkeda.dataset import Dataset, DatasetSplit

__all__ = ["get_spark", "checkpoint_dir", "read_table", "Dataset", "DatasetSplit"]
