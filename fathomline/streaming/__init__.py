"""Extensions: nothing here has a counterpart in the batch queries' model; new pages refresh an index as they come."""
