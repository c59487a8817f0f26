"""Web-page analytics on Spark: pages, selectors, links, crawls and results as DataFrames."""
