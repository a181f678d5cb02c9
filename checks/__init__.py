"""Driver tables as inputs of the operators, and the SQL the results are compared with."""
