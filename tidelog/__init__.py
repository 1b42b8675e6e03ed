"""tidelog: event-log analytics and delivery on Spark DataFrames."""
