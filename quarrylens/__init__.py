"""quarrylens: a PySpark-native analytics engine for captured web evidence."""
