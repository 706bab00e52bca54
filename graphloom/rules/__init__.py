"""Rule programs: a Datalog front end whose relations are DataFrames, and the resolver programs written in it."""
