"""Optional scores of domains by a sequence model in an ONNX file. Off unless a file is given; the heuristic score in `scalar` is the default."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import scalar


def model_score(domain: Column | str, path: str, length: int = 75) -> Column:
    """The model's probability for each domain's tokens, an Arrow batch at a time; one session in each worker, one thread."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for tokens in parts:
            if len(tokens):
                out = session.run(None, {name: np.stack(tokens.to_list()).astype(np.int64)})[0]
                yield pd.Series(np.asarray(out, float).reshape(len(tokens), -1)[:, -1])

    return run(scalar.domain_tokens(domain, length))
