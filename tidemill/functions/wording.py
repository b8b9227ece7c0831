"""The wording of findings, kept apart from the rules that decide them."""

# Texts whose wording users of the toolkit rely on, in reading order.

# insights
EMPTY_TABLE = "The dataset is empty. No analysis can be performed."
TABLE_SIZE = "Dataset contains {rows} records with {columns} columns."
NUMERIC_FINDING = "{column}: Mean = {mean:.2f}, Std Dev = {std}"
HIGH_VARIABILITY = "{column} shows high variability (CV = {cv:.2%})."
TEXT_FINDING = "{column}: {distinct} unique values. Most common: '{top}' ({pct:.1f}%)"
DOMINATED = "{column} is dominated by '{top}' ({pct:.1f}%). Consider if this represents a data quality issue."
MISSING_IN = "{column} has {count} missing values ({pct:.1f}%)."
ADDRESS_MISSING = "Address missing values through imputation or removal before detailed analysis."
NONE_MISSING = "No missing values detected in the dataset."
CORRELATION = "{strength} {sign} correlation ({r:.2f}) between {a} and {b}."
SEGMENT = "Consider segmenting the analysis by categorical variables for deeper insights."
SMALL_TABLE = "Dataset is relatively small. Results should be interpreted with caution."
LARGE_TABLE = "Dataset is large enough for meaningful statistical analysis and modeling."

# recommendations
UPLOAD_FIRST = "Upload a dataset to receive recommendations."
INCOMPLETE = "Data completeness is {pct:.1f}%. Consider data cleaning or imputation strategies."
COMPLETE = "Excellent data quality - no missing values detected."
SMALL_SAMPLE = "Small sample size. Statistical results may not be reliable. Consider collecting more data."
HIGH_CARDINALITY = "'{column}' has very high cardinality ({distinct} unique values). Consider grouping or encoding for analysis."
SEVERAL_NUMERIC = "Multiple numeric columns available. Consider correlation analysis and feature importance evaluation."
ENOUGH_NUMERIC = "Sufficient numeric features for clustering or dimensionality reduction."
COMPARE_ACROSS = "Consider comparing {measure} across different {category} categories for segmentation insights."

# cards: (type, title, content)
CARD_INCOMPLETE = (
    "risk",
    "Data Completeness Concern",
    "Dataset is only {pct:.1f}% complete with {missing:,} missing values. Consider cleaning before analysis.",
)
CARD_COMPLETE = ("finding", "Excellent Data Quality", "Dataset is {pct:.1f}% complete - ready for reliable analysis.")
CARD_OUTLIERS = (
    "risk",
    "Outliers in {column}",
    "Found {count} outliers ({pct:.1f}%) in '{column}'. This may skew statistical analyses.",
)
CARD_REDUNDANT = (
    "finding",
    "Strong Correlation Detected",
    "'{a}' and '{b}' have a correlation of {r:.2f}. Consider if one is redundant.",
)
CARD_DOMINANT = (
    "opportunity",
    "Dominant Category in {column}",
    "'{top}' accounts for {pct:.1f}% of values. Consider segmenting for deeper analysis.",
)
CARD_LARGE = (
    "recommendation",
    "Large Dataset",
    "With {rows:,} rows, consider sampling for exploratory analysis then validating on the full set.",
)

# issue queue
ISSUE_DUPLICATES = "Duplicate rows ({count})"
ISSUE_NULLS = "Missing values in '{column}' ({pct:.1f}%)"
ISSUE_OUTLIERS = "Outliers in '{column}' ({count} rows)"

# confidence
LARGE_SAMPLE = "Large sample ({rows:,} rows)"
ADEQUATE_SAMPLE = "Adequate sample ({rows:,} rows)"
FEW_ROWS = "Small sample ({rows:,} rows) — interpret with caution"
HIGH_COMPLETENESS = "High completeness ({pct:.0f}%)"
GOOD_COMPLETENESS = "Good completeness ({pct:.0f}%)"
NOTABLE_GAPS = "Notable missing data (completeness {pct:.0f}%)"
RULE_BASED = "Deterministic rule-based analysis"
GENERATED = "AI-generated — verify key numbers before acting"

# commentary
SCORED = "Dataset has {rows:,} rows and {columns} columns with a quality score of {score}/100."
COMPLETENESS_EXCELLENT = "Data completeness is excellent with virtually no missing values."
COMPLETENESS_GOOD = "Data completeness is good at {pct:.1f}%, though some cleaning may help."
COMPLETENESS_POOR = "Data completeness is {pct:.1f}% - significant cleaning is recommended before analysis."
DUPLICATES_FOUND = "Found {count:,} duplicate rows that may need attention."
WELL_SUITED = "Overall, this dataset is well-suited for analysis."
WORKABLE = "The dataset needs some preparation but is workable."
POOR = "Substantial data quality issues detected - thorough cleaning is strongly recommended."

# report
REPORT_OVERVIEW = (
    "This dataset contains {rows:,} records across {columns} variables. Of these, {numeric} are numeric and "
    "{text} are categorical. The data columns include: {names}."
)
REPORT_NUMERIC = (
    "Analyzing key numeric variables, '{column}' has a mean of {mean:.2f} with a standard deviation of {std}, "
    "ranging from {low:.2f} to {high:.2f}. {variable}The dataset contains {numeric} quantitative measures "
    "suitable for statistical analysis."
)
REPORT_VARIABLE = "High variability suggests significant differences across records. "
REPORT_TEXT = (
    "Among categorical variables, '{column}' contains {distinct} distinct values with '{top}' being the most "
    "frequent. This distribution may indicate natural groupings suitable for segmented analysis."
)
REPORT_QUALITY = (
    "Data quality assessment shows {pct:.1f}% completeness with {missing:,} missing values across the dataset. "
    "There are {duplicates:,} duplicate rows detected. {verdict}"
)
REPORT_READY = "The data is well-suited for analysis."
REPORT_CLEAN = "Data cleaning may be recommended before detailed analysis."

# brief
NO_BRIEF = "No data available for executive summary."
BRIEF_SIZE = "Dataset contains {rows:,} records across {columns} variables ({numeric} numeric, {text} categorical)."
BRIEF_COMPLETENESS = "Data completeness is {pct:.1f}% with {missing:,} missing values total."
BRIEF_MEASURE = "Key metric '{column}' averages {mean:,.2f} across the dataset."
BRIEF_CATEGORY = "Primary category '{column}' has {distinct} distinct values."
BRIEF_NEXT = "Recommended next steps: clean missing data, explore correlations, and segment by key categories."

# explanations of one number
NO_COLUMN = "Cannot explain: column not found."
NO_VALUES = "Cannot explain: column has no data."
TEXT_SHARE = "'{value}' appears {count} times in '{column}' ({pct:.1f}% of all values)."
MIDDLE = "This value ({value}) is at the {share:.0f}th percentile for '{column}'. The mean is {mean:.2f} and median is {median:.2f}."
EDGE = (
    "This value ({value}) is in the {edge} 5% for '{column}' ({mark} percentile). "
    "It is {away} standard deviations {side} the mean of {mean:.2f}."
)

# load checks
NO_ROWS = "The dataset is empty (no rows)."
NO_COLUMNS = "The dataset has no columns."
VERY_LARGE = "The dataset is very large ({rows:,} rows). Performance may be affected."
ALL_EMPTY = "The following columns are entirely empty: {columns}"

# statistical tests
TTEST_SMALL = "Each group needs at least 2 observations."
CHI2_SMALL = "Need at least 2 categories in each column."
ANOVA_SMALL = "Need at least 2 groups with 2+ observations each."
OLS_SMALL = "Not enough observations for regression."
LOGISTIC_SMALL = "Need at least 10 observations for logistic regression."
LOGISTIC_CLASSES = "Target must have at least 2 classes."
KMEANS_SMALL = "Need at least {k} observations for {k} clusters."
CLUSTER_LINE = "Cluster {cluster}: Characterized by {features}"
NO_CLUSTERS = "No cluster information available."

# Chart titles by kind, filled with the chart's columns.
CHART_TITLES = {
    "histogram": "Distribution of {0}",
    "bar": "Count by {0}",
    "heatmap": "Correlation Heatmap",
    "scatter": "{0} vs {1}",
    "line": "{1} over {0}",
    "box": "{1} by {0}",
}

# Reasons for calling a column personal, by what was found.
PERSONAL_BOTH = "Column name contains '{keyword}' and content matches {kind} pattern"
PERSONAL_CONTENT = "Content matches {kind} pattern"
PERSONAL_NAME = "Column name contains '{keyword}'"

# Texts of validation rules by type; a range by the bounds it has.
RULE_TEXTS = {
    "not_null": "`{column}` has no missing values",
    "unique": "`{column}` values are all unique",
    "range:": "`{column}` is numeric",
    "range:min": "`{column}` ≥ {min}",
    "range:max": "`{column}` ≤ {max}",
    "range:minmax": "`{column}` between {min} and {max}",
    "allowed_values": "`{column}` only in [{allowed}]",
    "regex": "`{column}` matches /{pattern}/",
}
RULE_OTHER = "`{column}`: {kind}"
