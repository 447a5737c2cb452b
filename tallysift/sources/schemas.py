"""Record shapes and file names of the result files."""

from pyspark.sql import types as T

# File names and column names of the stored result files.
HISTORY_FILE = "quantum_train_historical.csv"
PREDICTIONS_FILE = "quantum_aggregated_predictions.csv"
RUN_RECORDS_FILE = "quantum_raw_metrics.json"
COMPARISON_FILE = "model_comparison.csv"
COMPARISON_RUNS_FILE = "model_comparison_runs.csv"
SUMMARY_FILE = "summary_statistics.json"
COMBINED_SUMMARY_FILE = "summary_statistics_combined.json"
CLASS_KEYS = ("Negative (0)", "Positive (1)")
AVERAGE_KEYS = ("macro avg", "weighted avg")
REPORT_METRICS = ("precision", "recall", "f1-score", "support")
METRIC_ORDER = ("Accuracy", "Precision", "Recall", "F1", "ROC-AUC")

HISTORY = T.StructType([
    T.StructField("Run", T.IntegerType()),
    T.StructField("Epoch", T.IntegerType()),
    T.StructField("Metric", T.StringType()),
    T.StructField("Value", T.DoubleType()),
])

PREDICTIONS = T.StructType([
    T.StructField("Run", T.IntegerType()),
    T.StructField("True_Label", T.IntegerType()),
    T.StructField("Predicted_Label", T.IntegerType()),
    T.StructField("Prob_1", T.DoubleType()),
])

REPORT_LINE = T.StructType([T.StructField(m, T.DoubleType()) for m in REPORT_METRICS])
REPORT = T.StructType(
    [T.StructField(k, REPORT_LINE) for k in CLASS_KEYS + AVERAGE_KEYS]
    + [T.StructField("accuracy", T.DoubleType())]
)

RUN_RECORD = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("n_features", T.IntegerType()),
    T.StructField("n_test", T.IntegerType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("macro_f1", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("threshold_youden", T.DoubleType()),
    T.StructField("epochs_ran", T.IntegerType()),
    T.StructField("train_infrastructure", T.StringType()),
    T.StructField("eval_backend", T.StringType()),
    T.StructField("loss_history", T.ArrayType(T.DoubleType())),
    T.StructField("mean_best_history", T.ArrayType(T.DoubleType())),
    T.StructField("report", REPORT),
    T.StructField("report_dict", REPORT),
    T.StructField("y_true", T.ArrayType(T.IntegerType())),
    T.StructField("y_prob", T.ArrayType(T.DoubleType())),
])

COMPARISON = T.StructType([
    T.StructField("Model", T.StringType()),
    T.StructField("Metric", T.StringType()),
    T.StructField("Mean", T.DoubleType()),
    T.StructField("Std", T.DoubleType()),
])

COMPARISON_RUNS = T.StructType([
    T.StructField("Model", T.StringType()),
    T.StructField("Run", T.IntegerType()),
    T.StructField("Metric", T.StringType()),
    T.StructField("Value", T.DoubleType()),
])
