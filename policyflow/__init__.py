"""policyflow: insurance policy documents and product code tables on Spark DataFrames."""
