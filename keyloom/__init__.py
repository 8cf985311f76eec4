"""keyloom: a Spark-native identity-crosswalk and corpus engine."""
