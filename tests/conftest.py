import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siskin.session import session

    spark = session(
        "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="4g", spark_ui_showConsoleProgress="false",
        spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
