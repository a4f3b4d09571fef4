"""PySpark-native analytics for arrays of short, regularly spaced repeats."""
