from marrow.cli import main

raise SystemExit(main())
