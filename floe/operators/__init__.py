"""Table operators: ``DataFrame -> DataFrame`` functions and fitted estimators."""
