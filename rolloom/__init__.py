"""rolloom: the data side of reasoning-model training as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# the few Python helpers that run in tasks travel with the job: executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
