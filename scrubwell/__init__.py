"""Data-quality detection, cleaning and model comparison on Spark DataFrames."""

from scrubwell.operators.classes import class_distribution, class_imbalance, is_imbalanced
from scrubwell.operators.duplicates import drop_duplicates, duplicate_groups
from scrubwell.operators.evaluate import compare, evaluate
from scrubwell.operators.features import fit_features, max_bins, prepare_rows
from scrubwell.operators.issues import issue_report, issue_table
from scrubwell.operators.metrics import classification_metrics, confusion_counts, regression_metrics
from scrubwell.operators.missing import (
    handle_missing, missing_columns, missing_counts, missing_rows, offered_strategies,
)
from scrubwell.operators.outliers import (
    box_stats, numeric_outliers, outlier_report, rare_categories, remove_outliers,
)
from scrubwell.operators.profile import column_profile, top_values
from scrubwell.operators.resample import oversample, resample, train_test_split, undersample
from scrubwell.operators.skew import (
    categorical_entropy, fix_skew, high_skew_columns, numeric_skewness, skewness_report,
)
from scrubwell.operators.states import (
    bounds_of_states, merge_states, merge_values, quantiles_of_states, report_of_states, table_states, value_states,
)
from scrubwell.operators.target import index_target, target_correlation
from scrubwell.operators.text import clean_text_columns
from scrubwell.operators.timestamps import timestamp_features
from scrubwell.operators.words import fit_naive_bayes, word_statistics
from scrubwell.plans.cleaning import Cleaned, CleaningPlan, Step
from scrubwell.sources.tables import (
    CsvScan, before_after, preview, read_csv, read_table, row_counts, scan_csv, schema_listing, write_csv,
)
